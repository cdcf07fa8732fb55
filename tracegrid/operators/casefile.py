"""A case file for one alert, as HTML, Markdown or JSON; everything from the data is escaped."""

from __future__ import annotations

import html
import json

from .evidence import json_safe, verify

BANDS = ((0.85, "critical"), (0.70, "high"), (0.50, "medium"), (0.30, "low"), (0.0, "minimal"))


def band(score: float) -> str:
    return next(name for least, name in BANDS if score >= least)


def bars(parts: dict[str, float], width: int = 240) -> str:
    """The components as a small SVG."""
    rows = []
    for i, (name, value) in enumerate(sorted(parts.items(), key=lambda x: -x[1])):
        y, w = 22 * i, round(width * max(0.0, min(1.0, value)), 1)
        rows.append(f'<text x="0" y="{y + 14}" font-size="12">{html.escape(name)}</text><rect x="90" y="{y + 3}" width="{w}" height="14" fill="#888"/><text x="{95 + w}" y="{y + 14}" font-size="12">{value:.2f}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 150}" height="{22 * len(rows) + 4}">{"".join(rows)}</svg>'


def components(alert: dict) -> dict[str, float]:
    return {k[2:]: float(v or 0) for k, v in alert.items() if k.startswith("c_")}


def as_json(alert: dict) -> str:
    return json.dumps(json_safe(alert), indent=2, sort_keys=True)


def as_markdown(alert: dict) -> str:
    text = lambda x: str(x).replace("|", r"\|").replace("<", "&lt;")
    lines = [f"# Case {text(alert.get('alert_id'))}", "", f"Entity: `{text(alert.get('entity'))}` ({text(alert.get('entity_type'))})", f"Risk: {alert.get('risk', 0):.2f} ({band(alert.get('risk', 0))}), confidence {alert.get('confidence', 0):.2f}", f"Action: {text(alert.get('action'))}", "", "## Reasons", ""]
    lines += [f"* {text(r)}" for r in alert.get("reasons") or []] + ["", "## Components", "", "| part | value |", "|-|-|"]
    lines += [f"| {k} | {v:.2f} |" for k, v in sorted(components(alert).items(), key=lambda x: -x[1])]
    for c in alert.get("counterfactuals") or []:
        lines.append(f"\nWithout {text(c['evidence'])}: {c['score_without']:.2f}" + (" (leaves the list)" if c["decisive"] else ""))
    return "\n".join([*lines, "", f"Digest: `{text(alert.get('evidence_hash'))}`" + (" verified" if alert.get("evidence_hash") and verify(alert) else " not verified")])


def as_html(alert: dict) -> str:
    e = lambda x: html.escape(str(x))
    reasons = "".join(f"<li>{e(r)}</li>" for r in alert.get("reasons") or [])
    what_if = "".join(f"<li>without {e(c['evidence'])}: {c['score_without']:.2f}</li>" for c in alert.get("counterfactuals") or [])
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(alert.get('alert_id'))}</title></head><body><h1>{e(alert.get('entity'))}</h1><p>{e(alert.get('entity_type'))}, risk {alert.get('risk', 0):.2f} ({band(alert.get('risk', 0))}), "
        f"{e(alert.get('action'))}</p>{bars(components(alert))}<h2>Reasons</h2><ul>{reasons}</ul><h2>What if</h2><ul>{what_if}</ul><p><code>{e(alert.get('evidence_hash'))}</code></p></body></html>"
    )
