"""Scalar functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

_MISSING = ["", "nan", "none", "null", "[]"]


def is_missing(c: Column) -> Column:
    """Null, or one of the texts that stand for nothing."""
    return c.isNull() | F.lower(F.trim(c)).isin(_MISSING)


def blank_to_null(c: Column) -> Column:
    return F.when(~is_missing(c), F.trim(c))


def split_list(c: Column) -> Column:
    """Array of texts from '[...]', or split at the first of | ; , that occurs; blanks go."""
    t = F.trim(c)
    sep = F.when(t.contains("|"), F.split(t, r"\|")).when(t.contains(";"), F.split(t, ";")).when(t.contains(","), F.split(t, ",")).otherwise(F.array(t))
    parsed = F.from_json(F.translate(t, "'", '"'), "array<string>")
    parts = F.when(t.startswith("[") & parsed.isNotNull(), parsed).otherwise(sep)
    empty = F.array().cast("array<string>")
    return F.when(is_missing(c), empty).otherwise(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: ~is_missing(x)))


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(default))


def to_int(c: Column) -> Column:
    return F.trim(c).try_cast("double").cast("int")


def split_amounts(c: Column, expected: Column | None = None) -> Column:
    """Array of doubles, bad ones 0; padded with 0 or cut to ``expected``."""
    amounts = F.transform(split_list(c), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    if expected is None:
        return amounts
    return F.when(expected > 0, F.slice(F.concat(amounts, F.array_repeat(F.lit(0.0), expected)), F.lit(1), F.greatest(expected, F.lit(1)))).otherwise(F.array().cast("array<double>"))


def parse_timestamp(c: Column) -> Column:
    """Text or epoch seconds, or milliseconds beyond 1e11; UTC; null if neither."""
    number = F.trim(c).try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.when(is_missing(c), F.lit(None).cast("timestamp")).when(number.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(F.trim(c)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(c, F.lit(low)), F.lit(low))))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when((b == 0) | b.isNull() | a.isNull(), F.lit(default)).otherwise(F.nanvl(a / b, F.lit(default)))


def window_confidence(delta: Column, candidates: Column, window: float = config.WINDOW_SECONDS) -> Column:
    base = (1 - (1 - config.CONFIDENCE_FLOOR) * F.abs(delta) / window) / F.sqrt(candidates.cast("double"))
    return F.when(F.abs(delta) > window, F.lit(0.0)).otherwise(clamp(base))


def pop_cv(amounts: Column) -> Column:
    """Population deviation over mean of an array; 0 without a mean."""
    n = F.size(amounts)
    mean = array_sum(amounts) / n
    var = F.aggregate(amounts, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when((n > 0) & (mean != 0), F.sqrt(var) / mean).otherwise(F.lit(0.0))


def array_sum(amounts: Column) -> Column:
    return F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x)


def script_index(c: Column) -> Column:
    known = F.array_position(F.array(*(F.lit(s) for s in config.SCRIPT_TYPES)), c).cast("int")
    return F.when(known > 0, known - 1).otherwise(len(config.SCRIPT_TYPES) - 1)


def short_id(c: Column, keep: int = 8) -> Column:
    return F.when(F.length(c) > 2 * keep + 1, F.concat(F.left(c, F.lit(keep)), F.lit("…"), F.right(c, F.lit(keep)))).otherwise(c)


def node_label(c: Column, kind: Column) -> Column:
    return F.when(kind == "txid", F.substring(c, 1, 14)).when(kind == "wallet", F.concat(F.substring(c, 1, 8), F.lit("..."), F.right(c, F.lit(4)))).otherwise(c)


def format_btc(c: Column) -> Column:
    a = F.abs(c)
    unit = lambda scale, name: F.concat(F.format_number(c * scale, 4), F.lit(f" {name}"))
    return F.when((a >= 1) | (a == 0), unit(1, "BTC")).when(a >= 1e-3, unit(1e3, "mBTC")).when(a >= 1e-6, unit(1e6, "bits")).otherwise(unit(1e8, "sat"))


def sortable_stamp(c: Column) -> Column:
    return F.regexp_replace(c, "^([^ ]*) ", "$1T")


def risk_band(c: Column) -> Column:
    return F.when(c >= 0.85, "critical").when(c >= 0.70, "high").when(c >= 0.50, "medium").when(c >= 0.30, "low").otherwise("minimal")


def alert_id(kind: Column, entity: Column, index: Column) -> Column:
    """CT-{letter}- and eight hex digits of the digest of kind:entity:index."""
    letter = F.when(kind == "wallet", "W").when(kind == "transaction", "T").when(kind == "cluster", "C").when(kind == "ip", "I").otherwise("X")
    return F.concat(F.lit("CT-"), letter, F.lit("-"), F.upper(F.substring(F.sha2(F.concat_ws(":", kind, entity, index.cast("string")), 256), 1, 8)))


def ipv4_number(c: Column) -> Column:
    """The address as a number; null if it isn't four numbers up to 255."""
    parts = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    ok = F.trim(c).rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda x: x.between(0, 255))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x))


#: IPv4 blocks that aren't publicly routed.
PRIVATE_BLOCKS = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]


def is_private_ip(c: Column) -> Column:
    """Private, loopback, reserved or no valid address; IPv6 by its leading digits.

    The address is parsed once, in a list of one element, and its number held against all blocks there.
    """
    ranges = []
    for block in PRIVATE_BLOCKS:
        net, bits = block.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(net.split(".")))
        ranges.append((low, low + (1 << (32 - int(bits))) - 1))

    def inside(n: Column) -> Column:
        found = F.lit(False)
        for low, high in ranges:
            found = found | n.between(low, high)
        return found

    private4 = F.get(F.transform(F.array(ipv4_number(c)), inside), 0)
    v6 = F.lower(F.trim(c))
    private6 = v6.rlike(r"^(::1?$|f[cd]|fe[89ab]|2001:db8:)")
    return F.coalesce(private4, F.when(ip_version(c) == 6, private6).otherwise(F.lit(True)))


def ip_version(c: Column) -> Column:
    v6 = F.trim(c).rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$") & (F.length(F.trim(c)) - F.length(F.replace(F.trim(c), F.lit(":"))) >= 2)
    return F.when(ipv4_number(c).isNotNull(), 4).when(v6, 6)
