"""All SQL twins by query name."""

from __future__ import annotations

from oracle import bank, base, claims, combined, diagnosis, edits, extension, overlap, tags, patterns, regions, studies, reference


def build() -> dict[str, str]:
    out = {f"axis_{a}": base.axis_sql(a) for a in base.AXIS}
    out["fingerprint_axes"] = f"{base.FINGERPRINT}\nSELECT piece_id, axis, value FROM raw"
    for part in (reference, overlap, bank, patterns, edits, regions, studies, diagnosis, extension, claims, tags):
        out.update(part.build())
    return out | combined.build(out)
