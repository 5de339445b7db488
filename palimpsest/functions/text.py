"""Text scalars as Catalyst expressions. Identifiers in brackets are those of the survey's inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TOKEN = r"(?U)\b[\w'-]+\b"
NUMBER = r"(?U)(?i)(?<![\w.])(?:[$£€]\s*)?[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:%|(?:st|nd|rd|th)\b)?"
MONTH = r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
CASUALTY = r"(?i)\b(?:dead|deaths?|died|killed|injured|wounded|fatalities|casualties|death\s+toll|missing)\b"
SPORTS = r"(?i)\b(?:game|games|match|matches|season|inning|innings|quarter|halftime|touchdown|goal|goals|runs?|points?|score|scored|defeated|beat|won|lost|league|tournament|playoffs?|series)\b"
MONEY = r"(?i)(?:[$£€]\s*\d)|(?:\b\d+(?:\.\d+)?\s*(?:dollars?|euros?|pounds?|million|billion|trillion)\b)"
PERCENT = r"(?i)(?:\d+(?:\.\d+)?\s*%)|(?:\bpercent(?:age)?\b)"
UPDATE = r"(?i)\b(?:updated?|update|as\s+of|revised?)\b"
HONORIFIC = r"""(?i)^[“"(\[]?(?:Mr|Mrs|Ms|Dr|Gen|Gov|Col|Lt|Capt|Adm|Sgt|Cpl|Sen|Rep|Prof|St)\.$"""
BOILERPLATE = ("contributed reporting", "this article has been revised", "correction:", "sign up for", "newsletter", "[the new york times]", "_____")
STRAY = (".", ";", "&amp;")
SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=(?:["'“‘(\[]?[A-Z0-9]))|(?:\s*\n+\s*)"""
FLAT_SENTENCE_BREAK = r"""(?<=[.!?])\s+(?=["'“‘(\[]?[A-Z0-9])"""
WINNERS = {"model_a": "a", "model a": "a", "winner_model_a": "a", "model_b": "b", "model b": "b", "winner_model_b": "b", "tie": "tie", "tie (bothbad)": "both_bad", "both_bad": "both_bad", "both bad": "both_bad"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_space(x) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def straight_quotes(x) -> Column:
    """[F18]"""
    return F.translate(col(x), "“”‘’", "\"\"''")


def normalise_sentence(x) -> Column:
    """Also lower case and straight quotes, which are looked for first: few texts have others."""
    plain, quoted = F.lower(normalise_space(x)), F.lit(False)
    for q in "“”‘’":
        quoted = quoted | F.contains(col(x), F.lit(q))
    return F.when(quoted, straight_quotes(plain)).otherwise(plain)


def casefold(x) -> Column:
    """Lower case with the sharp s spelled out, as folding does."""
    return F.replace(F.lower(col(x)), F.lit("ß"), F.lit("ss"))


def normalise_audit(x) -> Column:
    """[F09]"""
    return casefold(normalise_space(x))


def normalise_temporal(x) -> Column:
    """Folded, with anything but word characters as one space."""
    return F.trim(F.regexp_replace(casefold(x), r"(?U)[^\w]+", " "))


def tokens(x) -> Column:
    """[F03]"""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(TOKEN), F.lit(0))


def split_tokens(x) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(col(x), r"(?U)\s+"), lambda t: t != "")


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Of token arrays: both_empty if both are empty, 0 if one is."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), both_empty).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def lexical_jaccard(a, b) -> Column:
    """[F04, U04]"""
    return jaccard(tokens(a), tokens(b))


def token_overlap(a, b) -> Column:
    """[F32] Of lower-cased white-space tokens; 0 if either has none."""
    return jaccard(split_tokens(F.lower(col(a))), split_tokens(F.lower(col(b))), 0.0)


def sentence_split(x) -> Column:
    """[F05, R06] Paragraph breaks are kept as sentence breaks."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\r\n?", "\n"), r"[\t\f\x0B ]+", " ")
    return F.filter(F.transform(F.split(cleaned, SENTENCE_BREAK), normalise_space), lambda s: s != "")


def sentence_split_flat(x) -> Column:
    """White space is collapsed first, so line ends do not split."""
    return F.filter(F.transform(F.split(normalise_space(x), FLAT_SENTENCE_BREAK), F.trim), lambda s: s != "")


def valid_sentence(x, least: int = 20, most: int = 500) -> Column:
    """[P06]"""
    return F.length(col(x)).between(least, most) & (F.size(tokens(x)) >= 3)


def valid_temporal(x, least: int = 20, most: int = 500) -> Column:
    """[P07]"""
    return F.length(col(x)).between(least, most) & col(x).rlike(r"\p{L}")


def context_before(sentences: Column, index: Column, k: int = 1) -> Column:
    """[F07, W03] index counts from 0."""
    start = F.greatest(F.lit(0), index - k)
    return F.array_join(F.slice(sentences, start + 1, index - start), " ")


def context_after(sentences: Column, index: Column, k: int = 1) -> Column:
    return F.array_join(F.slice(sentences, index + 2, F.lit(k)), " ")


def numbers(x) -> Column:
    """Numbers without spaces and commas, folded."""
    return F.transform(F.regexp_extract_all(col(x), F.lit(NUMBER), F.lit(0)), lambda n: casefold(F.regexp_replace(n, r"[\s,]", "")))


def mask_numbers(x) -> Column:
    """[F13]"""
    return F.regexp_replace(col(x), NUMBER, "<NUM>")


def has(x, pattern: str) -> Column:
    """[F14]"""
    return col(x).rlike(pattern)


def boundary_artifact(before, after, a, b) -> Column:
    """[P09]"""
    one = lambda x: F.trim(col(x)).rlike(HONORIFIC) | F.trim(col(x)).isin(*STRAY)
    last = lambda x: F.coalesce(F.try_element_at(split_tokens(x), F.lit(-1)), F.lit("")).rlike(HONORIFIC)
    return one(before) | one(after) | last(a) | last(b)


def boilerplate(*parts) -> Column:
    """[P10]"""
    text = casefold(F.concat_ws(" ", *[col(p) for p in parts]))
    found = F.lit(False)
    for term in BOILERPLATE:
        found = found | F.contains(text, F.lit(term))
    return found


def numeric_version(x) -> Column:
    """[F15]"""
    digits = F.regexp_extract(col(x).cast("string"), r"-?\d+(?:\.\d+)?", 0)
    return F.when(digits != "", digits.cast("double"))


def mismatch_category(a, b) -> Column:
    """Which normalisation makes two sentences equal."""
    x, y = normalise_space(a), normalise_space(b)
    p, q = straight_quotes(x), straight_quotes(y)
    return (
        F.when(x == y, "whitespace_only").when(F.lower(x) == F.lower(y), "case_only").when(p == q, "quote_style_only").when(F.lower(p) == F.lower(q), "case_and_quote_style")
        .when(normalise_sentence(a) == normalise_sentence(b), "other_existing_normalization").otherwise("not_explained_by_existing_normalization")
    )


def serialise_episode(before, a, b, after) -> Column:
    """[F19, F20]"""
    return F.concat_ws("\n", F.lit("[CONTEXT_BEFORE]"), col(before), F.lit("[CANDIDATE_A]"), col(a), F.lit("[CANDIDATE_B]"), col(b), F.lit("[CONTEXT_AFTER]"), col(after))


def serialise_temporal(before, earlier, later, after) -> Column:
    return F.concat(F.lit("[CONTEXT_BEFORE] "), col(before), F.lit(" [CANDIDATE_A] "), col(earlier), F.lit(" [CANDIDATE_B] "), col(later), F.lit(" [CONTEXT_AFTER] "), col(after))


def token_count(x) -> Column:
    """[F21, F22]"""
    return F.size(split_tokens(x))


def numeric_token_count(x) -> Column:
    """[F33]"""
    return F.size(F.filter(split_tokens(x), lambda t: t.rlike(r"\d")))


def jsonish_length(x) -> Column:
    """[F35]"""
    return F.length(F.coalesce(col(x).cast("string"), F.lit("")))


def word_count(x) -> Column:
    """[F36]"""
    return F.regexp_count(F.coalesce(col(x), F.lit("")), F.lit(r"(?U)\w+"))


def compare_scores(a, b) -> Column:
    """0 where a is higher, 1 where b is, null where equal."""
    return F.when(col(a) > col(b), 0).when(col(b) > col(a), 1)


def opposite(x) -> Column:
    """[F34]"""
    return F.when(col(x) == "A", "B").when(col(x) == "B", "A")


def normalise_winner(x) -> Column:
    """[P17]"""
    text = F.lower(F.trim(col(x)))
    out = F.when(col(x).isNull(), "unknown")
    for k, v in WINNERS.items():
        out = out.when(text == k, v)
    return out.when(F.contains(text, F.lit("both")) & F.contains(text, F.lit("bad")), "both_bad").when(text == "", "unknown").otherwise(text)


def stable_hash(*parts) -> Column:
    """Hexadecimal SHA-256 of parts with unit separators; its order is that of the leading 64-bit number."""
    return F.sha2(F.concat_ws("\x1f", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def hash_bit(hex_digest: Column, at: int = 2) -> Column:
    """Parity of one hexadecimal digit."""
    return F.conv(F.substring(hex_digest, at, 1), 16, 10).cast("int") % 2


def sigmoid(x) -> Column:
    """[F37]"""
    return 1 / (1 + F.exp(-col(x)))


def linear_schedule(step, warmup: int, total: int) -> Column:
    """Rises to 1 over warm-up, then falls to 0."""
    s = col(step)
    return F.when(s < warmup, s / max(1, warmup)).otherwise(F.greatest(F.lit(0.0), (total - s) / max(1, total - warmup)))


def binary_entropy(rate) -> Column:
    """[G39]"""
    r = col(rate)
    return F.when((r <= 0) | (r >= 1), 0.0).otherwise(-(r * F.ln(r) + (1 - r) * F.ln(1 - r)))


def log_loss(label, p, epsilon: float = 1e-7) -> Column:
    """[G23, G24] epsilon is 1e-7 for probes and 1e-12 for scripted ablations."""
    q = F.greatest(F.least(col(p), F.lit(1 - epsilon)), F.lit(epsilon))
    return -F.when(col(label) == 1, F.ln(q)).otherwise(F.ln(1 - q))


def brier(label, p) -> Column:
    """[G25]"""
    return F.pow(col(p) - col(label), 2)


def close(a, b, tolerance: float = 1e-5) -> Column:
    """[F41, F42]"""
    return F.abs(col(a) - col(b)) <= F.greatest(tolerance * F.greatest(F.abs(col(a)), F.abs(col(b))), F.lit(tolerance))


def classify_interval(lower, upper) -> Column:
    """[F43]"""
    return F.when(col(lower) > 0, "supported").when(col(upper) < 0, "degraded").otherwise("not_supported")


def wilson(successes, total, z: float = 1.96, clamp: bool = False) -> tuple[Column, Column]:
    """[G15-G19] Lower and upper bound; null for no observations."""
    n = F.nullif(col(total).cast("double"), F.lit(0.0))
    p = col(successes) / n
    bottom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / bottom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / bottom
    lower, upper = centre - half, centre + half
    return (F.greatest(F.lit(0.0), lower), F.least(F.lit(1.0), upper)) if clamp else (lower, upper)


def risk_ratio(successes, total, all_successes, all_total) -> Column:
    """[G14] Of a group against its complement; null if the complement has no success or either is empty."""
    s, n, cs, cn = col(successes), col(total), col(all_successes) - col(successes), col(all_total) - col(total)
    return F.when((n > 0) & (cn > 0) & (cs > 0), (s / n) / (cs / cn))


def share(a, b) -> Column:
    """Zero-safe division."""
    return F.when(col(b) == 0, 0.0).otherwise(col(a) / col(b))


def context_view(before="context_before", after="context_after") -> Column:
    """[F24]"""
    return F.concat_ws("\n", F.lit("[CONTEXT_BEFORE]"), F.coalesce(col(before), F.lit("")), F.lit("[CONTEXT_AFTER]"), F.coalesce(col(after), F.lit("")))


def candidate_view(candidate, before="context_before", after="context_after") -> Column:
    """[F23]"""
    return F.concat_ws("\n", F.lit("[CONTEXT_BEFORE]"), F.coalesce(col(before), F.lit("")), F.lit("[CANDIDATE]"), col(candidate), F.lit("[CONTEXT_AFTER]"), F.coalesce(col(after), F.lit("")))
