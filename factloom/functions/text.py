"""Text cleaning, tokens and patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, units and patterns of the domain.
BLANK = ["", "-", "--", "n/a", "na", "none", "not provided", "tbd", "unknown", "not applicable", "see plan", "x"]
STOPWORDS = ["to", "of", "the", "a", "an", "in", "on", "and", "for", "from", "at", "by", "with", "or"]
WEAK = ["to", "of", "the", "a", "an", "in", "on", "no", "number", "distance", "type", "site", "rate", "area", "system", "n", "s", "e", "w", "x", "y"]
DISTANCE_WORDS = ["distance", "dist", "setback", "setbacks", "isolation", "separation", "clearance", "offset"]
NOT_A_DISTANCE = ["abandoned", "abandon", "abandonment", "existing", "proposed", "prop", "report", "reports", "copy", "page", "adjustment", "affected", "amount", "submitted", "construction", "contruction", "capacity", "date", "arc", "supply", "install", "installed", "depth", "diameter", "casing", "yield"]
UNITS = {
    "feet": ["ft", "feet", "foot", "'"],
    "inches": ["in", "inch", "inches", '"'],
    "minutes per inch": ["mpi", "mpl", "pmi", "mp1", "min", "mins", "minute", "minutes"],
    "gallons per day": ["gpd", "gal", "gallons", "gallon"],
    "percent": ["%", "percent", "pct"],
    "holes": ["hole", "holes"],
    "bedrooms": ["bedroom", "bedrooms", "br"],
}
OTHER_UNITS = ["gpm", "mgd", "acre", "acres", "sf", "sq", "lbs", "psi", "degrees"]
UNIT_FAMILIES = [
    ("percolation", r"minutes?\s+per\s+inch|min(?:ute)?s?/inch|\bmpi\b|percolation\s+rate"),
    ("area", r"square\s+feet|square\s+foot|sq\.?\s*ft\.?|\bacres?\b|\bsf\b"),
    ("volume", r"gallons?\s+per\s+day|\bgpd\b|gallons?|\bcubic\s+(?:feet|yards?)\b"),
    ("slope", r"percent\s+slope|\bslope\b|\bpercent\b|%"),
    ("distance", r"\bfeet\b|\bfoot\b|\bft\.?\b|\binches\b|\binch\b|\bin\.\b|\bmiles?\b"),
    ("depth", r"\bdepth\b|\bdeep\b|\bthick(?:ness)?\b"),
    ("concentration", r"\bmg/l\b|\bmilligrams?\s+per\s+liter\b|\bppm\b"),
    ("time", r"\bdays?\b|\byears?\b|\bhours?\b|\bmonths?\b"),
]
OBLIGATION = r"\b(shall|must|may\s+not|shall\s+not|is\s+required|are\s+required|minimum|maximum|no\s+less\s+than|no\s+more\s+than|at\s+least|not\s+exceed|prohibited)\b"
OBLIGATION_WIDE = OBLIGATION.replace("prohibited", r"greater\s+than|less\s+than|prohibited")
SETBACK = r"\b(setback|separation|isolation\s+distance|horizontal\s+distance|vertical\s+separation|buffer|property\s+line|well|water\s+body|surface\s+water|dwelling|foundation)\b"
EXCEPTION = r"\b(except\s+(?:as|that|where|when|for)|exception|notwithstanding|unless|provided\s+that|does\s+not\s+apply|shall\s+not\s+apply|excluded?\s+from|exempted?\s+from|waiver|variance)\b"
BLOCKED_TOPICS = ["approv", "deny", "denied", "exception", "reduction", "reduce", "variance", "waiver", "relocat", "redesign", "move the", "moved", "lesser distance", "department approval", "note a", "note b", "note e", "note h", "note i", "ephemeral"]
PERSONAL_KEYS = ["owner_name", "owner_names", "applicant_name", "applicant", "contact_name", "contact", "phone", "phone_number", "email", "email_address", "address", "mailing_address", "street_address", "owner_address", "parcel_owner", "property_owner", "document_hash"]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
NOTES = r"(?i),?\s*notes?\s+[a-z](?:\s*,\s*[a-z])*"
CURLY = {"–": "-", "—": "-", "“": '"', "”": '"', "‘": "'", "’": "'", "ô": '"', "ö": '"', "õ": "'", "Õ": "'", "Æ": "-", "Ð": "-", "·": "-"}


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once; an expression that stands several times in another is otherwise computed each time."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(BLANK), F.lit(True))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", " "), " +"), lambda t: t != "")


def significant(t: Column) -> Column:
    return F.array_distinct(F.filter(t, lambda x: ~x.isin(STOPWORDS) & (F.length(x) > 1)))


def literal_words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def label_score(label: Column, candidates: list[str], distance: bool, own: Column | None = None) -> Column:
    """How well a form label names one of the candidates; 0 if it doesn't. ``own`` are the label's tokens, where they are known.

    The label must be short, hold every significant word of the candidate and at most two more;
    a distance needs a distance word, unless the label is the candidate and nothing else.
    """
    import re

    words = lambda s: [t for t in re.sub("[^a-z0-9 ]", " ", s.lower()).split(" ") if t]

    def score(own: Column, mine: Column) -> Column:
        scores = [F.lit(0)]
        for candidate in candidates:
            every = words(candidate)
            need = sorted({t for t in every if t not in STOPWORDS and len(t) > 1})
            if not need:
                continue
            left = F.size(F.array_except(mine, literal_words(need)))
            fits = F.size(F.array_except(literal_words(need), own)) == 0
            if len(every) > 1:
                fits = fits & (F.size(own) > 1)
            fits = fits & (left <= 2)
            if distance:
                fits = fits & (F.arrays_overlap(own, literal_words(DISTANCE_WORDS)) | (left == 0))
            scores.append(F.when(fits, F.lit(10 + len(need)) - left).otherwise(F.lit(0)))
        ok = F.size(F.array_except(mine, literal_words(WEAK))) > 0
        if distance:
            ok = ok & ~F.arrays_overlap(own, literal_words(NOT_A_DISTANCE))
        return F.when(ok, F.greatest(*scores) if len(scores) > 1 else scores[0]).otherwise(F.lit(0))

    of = lambda own: F.when((F.length(label) <= 48) & F.size(own).between(1, 8), once(significant(own), lambda mine: score(own, mine))).otherwise(F.lit(0))
    return of(own) if own is not None else once(tokens(label), of)


MEASUREMENT = r"(?is)^\s*(?:(?:min|max|approx|approximately|about|avg|average|est)\.?\s+|[<>~=+]\s*)*([-+]?\d{1,4}(?:,\d{3})?(?:\.\d+)?)\s*(.*)$"


def measurement(c: Column, units: str) -> Column:
    """Struct of ``value`` and ``refused``: the number must lead, be the only one, and carry no other unit."""
    expected = UNITS.get(units, [])
    wrong = [u for us in [*UNITS.values(), OTHER_UNITS] for u in us if u not in expected]

    def of(raw: Column, rest: Column, parts: Column) -> Column:
        bare = F.array_union(F.transform(parts, lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), parts)
        refused = (
            F.when(raw.isNull() | ~raw.rlike(MEASUREMENT), "prose")
            .when(rest.rlike(r"\d"), "several numbers")
            .when(F.size(parts) > 2, "phrase")
            .when(F.arrays_overlap(bare, literal_words(wrong)), "other unit")
            .when((F.size(parts) > 0) & ~F.arrays_overlap(bare, literal_words(expected or [""])), "not a unit")
        )
        value = F.replace(F.regexp_extract(raw, MEASUREMENT, 1), F.lit(","), F.lit("")).try_cast("double")
        return once(refused, lambda refused: F.struct(F.when(refused.isNull(), value).alias("value"), refused.alias("refused")))

    split = lambda rest: F.filter(F.split(F.lower(rest), r"[\s,;:()/]+"), lambda t: t.rlike("[a-z0-9%'\"]"))
    return once(squeeze(c), lambda raw: once(F.trim(F.regexp_extract(raw, MEASUREMENT, 2)), lambda rest: once(split(rest), lambda parts: of(raw, rest, parts))))


def demojibake(c: Column) -> Column:
    """Curly and mis-decoded punctuation as plain characters."""
    return F.translate(c, "".join(CURLY), "".join(CURLY.values()))


def nfkc(c: Column) -> Column:
    """Compatibility composition; Spark has none, so Arrow batches do it."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return normal(c)


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, r"(\w)-\s+(\w)", "$1$2")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.;:])\s+(?=[A-Z(\"'])")


def numbers_in(c: Column) -> Column:
    """Numbers that could be thresholds: those next to a dot are section numbers."""
    return F.regexp_extract_all(c, F.lit(r"(?<![.\d])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![.\d]*\.\d|\d)"), 1)


def units_in(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike("(?i)" + p), F.lit(n)) for n, p in UNIT_FAMILIES]))


def has_obligation(c: Column, wide: bool = True) -> Column:
    return c.rlike("(?i)" + (OBLIGATION_WIDE if wide else OBLIGATION))


def has_setback(c: Column) -> Column:
    return c.rlike("(?i)" + SETBACK)


def passage_score(c: Column) -> Column:
    return has_obligation(c).cast("int") * 2 + has_setback(c).cast("int")


def redact(c: Column) -> Column:
    """E-mail addresses first, then phone numbers."""
    return F.regexp_replace(F.regexp_replace(c, EMAIL, "[email redacted]"), PHONE, "[phone redacted]")


def strip_notes(c: Column) -> Column:
    return strip(F.regexp_replace(c, NOTES, ""))


def is_blocked(c: Column) -> Column:
    return F.lower(c).rlike("|".join(BLOCKED_TOPICS))


def section_parent(c: Column) -> Column:
    return F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]+$", ""))


def section_depth(c: Column) -> Column:
    return F.size(F.split(c, r"\."))


def section_key(c: Column) -> Column:
    """Sort key of dotted numbers."""
    return F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))


XREF = r"(?:(?:[Ss]ections?)\s+|(?:in|per|of|under|above|below|see|from|pursuant\s+to|referenced\s+in|accordance\s+with|required\s+(?:by|in|under)|specified\s+in|described\s+in|defined\s+in|provided\s+in|set\s+forth\s+in|established\s+in|identified\s+in|listed\s+in|outlined\s+in)\s+)(\d{1,2}(?:\.\d{1,3}){1,4})"
EXHIBIT = r"Exhibit\s+([A-Z][A-Z0-9]?(?:-\d+)?)"
DEFINITION = r'"([^"]{3,60})"\s+means\b'


def section_refs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(XREF), 1))


def exhibit_refs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(EXHIBIT), 1))


def definitions(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DEFINITION), 1)


def citation_node(c: Column) -> Column:
    """Node id of a citation: a section, an exhibit, or null."""
    text = strip(c)
    exhibit = r"(?i)^Exhibit\s+([A-Z][A-Z0-9]?(?:-\d+)?)$"
    return F.when(text.isNull() | text.isin("", "TBD"), F.lit(None).cast("string")).when(text.rlike(exhibit), F.concat(F.lit("exhibit:"), F.upper(F.regexp_extract(text, exhibit, 1)))).otherwise(F.concat(F.lit("section:"), text))


def slug(c: Column, most: int = 60) -> Column:
    own = F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9._-]+", "-"), r"^-+|-+$", "")
    return F.left(F.when(own == "", "unknown").otherwise(own), F.lit(most))


def object_key(root: str, row_id: Column, number: Column, status: Column, index: Column, kind: Column) -> Column:
    return F.concat(F.lit(root + "/status="), slug(status, 40), F.lit("/"), row_id.cast("string"), F.lit("_"), slug(number, 30), F.lit("/"), F.lpad(index.cast("string"), 2, "0"), F.lit("_"), slug(kind, 30), F.lit(".pdf"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "_")


def summary(pairs: list[tuple[str, Column]]) -> Column:
    """``label value; label value`` without nulls, blanks and NaN texts."""
    keep = lambda v: F.when(~F.lower(F.trim(v.cast("string"))).isin("", "nan"), v.cast("string"))
    return F.concat_ws("; ", *[F.when(keep(v).isNotNull(), F.concat(F.lit(n + " "), keep(v))) for n, v in pairs])


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %02ds", (s / 60).cast("long"), s % 60)).otherwise(F.format_string("%dh %02dm", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long")))


def cypher_literal(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))


def is_throttled(c: Column) -> Column:
    return F.lower(c).rlike("throttl|too many requests|rate exceeded|serviceunavailable|timeout")


def wrap_lines(c: Column, width: int) -> Column:
    """Words packed into lines of at most ``width`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, word: Column) -> Column:
        joined = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        fits = (F.length(joined) <= width) | (acc["line"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, joined).otherwise(word).alias("line"))

    return F.aggregate(F.filter(F.split(c, r"\s+"), lambda w: w != ""), start, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))
