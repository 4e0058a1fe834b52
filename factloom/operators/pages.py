"""Which page is a drawing: weighted phrases, written scales, dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.text import squeeze

#: Phrases with their weights; weights and limits of the rest.
PHRASES = {
    "site plan": 5.0, "graphic scale": 5.0, "plot plan": 5.0, "site & cross section": 4.0, "cross section": 2.5, "not to scale": 2.0,
    "existing well": 2.0, "proposed well": 2.0, "new well": 1.5, "septic tank": 1.5, "dosing chamber": 1.5, "distribution box": 1.5, "disposal area": 1.5, "sand mound": 1.5, "spare area": 1.5,
    "isolation distance": 2.0, "property line": 1.5, "tax map": 1.0, "tax parcel": 0.5, "benchmark": 1.0, "limiting zone": 1.0, "perc rate": 0.5, "north": 0.5,
}
RATIO = r"(?i)1\s*(?:\"|''|”|\s*in(?:ch)?\.?)\s*=\s*\d+\s*(?:'|’|ft|feet)?"
CALLOUT = r"\b\d{1,4}(?:\.\d+)?\s*(?:'|’)(?:\s|$|[,.)])"
RATIO_WEIGHT, CALLOUT_FLOOR, CALLOUT_WEIGHT, CALLOUT_CAP, FIELD_CEILING, FORM_FACTOR = 4.0, 4, 0.4, 4.0, 12, 0.4


def score(text: Column, form_fields: Column) -> Column:
    """Struct of the score and whether the page looks drawn; many form fields make it a form."""
    low, ratio, dims = squeeze(F.lower(text)), text.rlike(RATIO), F.regexp_count(text, F.lit(CALLOUT))
    total = sum((F.when(low.contains(p), F.lit(w)).otherwise(0.0) for p, w in PHRASES.items()), F.lit(0.0))
    total = total + F.when(ratio, RATIO_WEIGHT).otherwise(0.0) + F.when(dims >= CALLOUT_FLOOR, F.least(F.lit(CALLOUT_CAP), dims * CALLOUT_WEIGHT)).otherwise(0.0)
    drawn = low.contains("graphic scale") | ((dims >= CALLOUT_FLOOR) & ratio) | (dims >= 3 * CALLOUT_FLOOR)
    return F.struct((total * F.when(form_fields > FIELD_CEILING, FORM_FACTOR).otherwise(1.0)).alias("score"), drawn.alias("drawn"))
