"""Scalar functions, Column to Column."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("", "null", "none", "nan")


def text_or_null(c: Column) -> Column:
    """Trimmed and lower-cased; blank and spelled-out nulls become NULL."""
    t = F.lower(F.trim(c))
    return F.when(~t.isin(*NULL_WORDS), t)


def session_or_null(c: Column) -> Column:
    """Trimmed, case kept; blank becomes NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def event_time(c: Column) -> Column:
    """A timestamp from ``yyyy-MM-dd HH:mm:ss`` with or without a trailing UTC, else NULL."""
    return F.try_to_timestamp(F.regexp_replace(c, r"\s+UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def category_levels(code: Column) -> tuple[Column, Column, Column]:
    """First, second and all further parts of a dotted code."""
    parts = F.split(code, r"\.")
    rest = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts), F.lit(2)) - 2), ".")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.when(F.size(parts) > 2, rest)


def fingerprint(*cols: Column, null_token: str = "_null_", sep: str = "||") -> Column:
    """sha-256 of the values as text."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit(null_token)) for c in cols]), 256)


def seconds_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def hour_id(c: Column) -> Column:
    return F.date_format(c, "yyyyMMddHH")


def safe_rate(num: Column, den: Column) -> Column:
    """num / den as double; 0.0 where den is NULL or 0."""
    return F.when(den.isNull() | (den == 0), F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def money(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("decimal(18,2)")


def count_of(type_col: Column, value: str) -> Column:
    return F.count_if(type_col == value)


def ci_equals(c: Column, value: str | Column) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.lower(F.trim(c)) == F.lower(F.trim(v))


def ci_not_equals(c: Column, value: str | Column) -> Column:
    return ~ci_equals(c, value)


def known_member(c: Column) -> Column:
    return F.lower(F.trim(c)) != "unknown"


def not_digits(c: Column) -> Column:
    return ~c.rlike("^[0-9]+$")


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def run_seconds(start: Column, end: Column) -> Column:
    """Duration, never negative."""
    return F.greatest(seconds_between(start, end), F.lit(0))


def json_or(c: Column, schema: str, default: Column) -> Column:
    """A JSON object parsed by a DDL schema; the default where it is missing, malformed or no object."""
    parsed = F.from_json(c, f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"})
    good = F.trim(c).startswith("{") & parsed["__broken"].isNull()
    return F.coalesce(F.when(good, parsed.dropFields("__broken")), default)


# ---------------------------------------------------------------- text

@lru_cache(maxsize=1)
def _decomposed() -> tuple[str, str, dict[str, str]]:
    """From Unicode's decompositions of every assigned code point, without nonspacing marks: letters with a plain form of one
    letter and their plain forms (marks follow without one, so they are removed), and the few with more."""
    one, many, marks = {}, {}, []
    for point in range(0x80, 0x110000):
        c = chr(point)
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:  # surrogates, and Hangul, which follows a rule
            continue
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if plain != c:
            (one if len(plain) == 1 else many)[c] = plain
    return "".join(one) + "".join(marks), "".join(one.values()), many


def _hangul(c: Column) -> Column:
    """Hangul syllables as the letters they are made of: 19 leading, 21 vowels, 27 trailing or none."""
    lead, vowel, tail = (F.array(*[F.lit(chr(x)) for x in r]) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))

    def letters(x: Column) -> Column:
        s = F.ascii(x) - 0xAC00
        made = F.concat(F.get(lead, F.floor(s / 588).cast("int")), F.get(vowel, F.floor(s % 588 / 28).cast("int")), F.coalesce(F.get(tail, (s % 28 - 1).cast("int")), F.lit("")))
        return F.when(s.between(0, 11171), made).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), letters), "")


def strip_marks(c: Column) -> Column:
    """Canonically decomposed, without nonspacing marks.  Spark has no normalisation, so code points are mapped; ASCII
    texts are left as they are."""
    source, target, many = _decomposed()
    plain = F.translate(c, source, target)
    spread = reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(many[k])), many, plain)
    out = F.when(plain.rlike("[" + "".join(many) + "]"), spread).otherwise(plain)
    out = F.when(out.rlike("[\uac00-\ud7a3]"), _hangul(out)).otherwise(out)
    return F.when(c.rlike("[^\\x00-\\x7f]"), out).otherwise(c)


def fold_accents(c: Column) -> Column:
    """Lower case without accents; the barred d is a d."""
    return F.translate(strip_marks(F.lower(c)), "đ", "d")


def fold_words(c: Column) -> Column:
    """Folded; other characters than letters and digits become single spaces."""
    return F.trim(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", " "))


def first_term(c: Column, terms: list[str], whole_word: bool = False) -> Column:
    """The first of the terms that the text contains."""
    hit = (lambda t: c.rlike("\\b" + t + "\\b")) if whole_word else (lambda t: c.contains(t))
    return F.coalesce(*[F.when(hit(t), F.lit(t)) for t in terms])


def tag_terms(c: Column, categories: dict[str, list[str]], default: str = "safe", whole_word: bool = False) -> tuple[Column, Column]:
    """(category, matched term); categories are tried in order."""
    hits = {k: first_term(c, v, whole_word) for k, v in categories.items()}
    tag = reduce(lambda w, k: w.when(hits[k].isNotNull(), k), list(hits)[1:], F.when(hits[next(iter(hits))].isNotNull(), next(iter(hits)))).otherwise(default)
    return tag, F.coalesce(*hits.values())


#: Terms that mark a question, after folding of accents.
RISKY_TERMS = {
    "destructive": [
        "drop", "delete", "truncate", "update", "insert", "alter", "create", "merge", "grant", "revoke",
        "xoa bang", "xoa du lieu", "xoa het", "cap nhat du lieu", "sua du lieu", "them du lieu",
    ],
    "injection": [
        "ignore previous", "ignore all previous", "ignore instructions", "bypass", "jailbreak", "system prompt", "developer message",
        "khong can truy van", "khong can query", "tra loi ngay", "answer directly", "answer immediately",
    ],
}
#: Keywords that a read-only statement may not hold.
FORBIDDEN_SQL = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "MERGE", "CALL", "GRANT", "REVOKE", "EXECUTE"]
#: Words that end a phrase after an anchor, and the anchors of a brand.
PHRASE_STOPS = (
    "ai bao bang cao cho co con cua doanh duoc giu hang hay hieu la loc luot mua nam nao nhan nhat nhieu ngay san sap theo "
    "thang thu thuong top tong trong vao ve xem year month date revenue sales view views"
).split()
BRAND_ANCHORS = ["cua", "brand", "hang", "nhan hang", "thuong hieu"]
#: Columns whose literals must be lower case, and the fields that question words ask for.
TEXT_COLUMNS = ["brand", "category_l1", "category_l2", "category_l3", "event_type"]
EXPECTED_FIELDS = {
    "brand": ["brand", "nhan hang", "thuong hieu", "hang"],
    "product_id": ["san pham", "product"],
    "view": ["luot xem", "view"],
}


def clean_sql(c: Column) -> Column:
    """Without code fences, surrounding blanks and one closing semicolon."""
    fenced = F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)^\\s*```(?:sql)?\\s*|\\s*```\\s*$", "")
    return F.regexp_replace(F.regexp_replace(fenced, "^\\s+", ""), "\\s*;?\\s*$", "")


def strip_sql(c: Column) -> Column:
    """Comments become a blank, literals and quoted names empty ones."""
    plain = F.regexp_replace(F.regexp_replace(c, "--[^\\n]*", " "), "(?s)/\\*.*?\\*/", " ")
    return F.regexp_replace(F.regexp_replace(plain, "'(?:''|[^'])*'", "''"), '"(?:""|[^"])*"', '""')


def has_limit(c: Column) -> Column:
    return strip_sql(clean_sql(c)).rlike("(?i)\\bLIMIT\\b")


def default_limit_sql(c: Column, n: int = 100) -> Column:
    """The statement with a LIMIT if it has none; n <= 0 leaves it."""
    plain = clean_sql(c)
    return plain if n <= 0 else F.when(has_limit(c), plain).otherwise(F.concat(plain, F.lit(f"\nLIMIT {n}")))


def readonly_class(c: Column) -> Column:
    """empty, multiple_statements, not_select, forbidden_keyword or safe; the first that holds."""
    plain = clean_sql(c)
    words = "(?i)\\b(" + "|".join(FORBIDDEN_SQL) + ")\\b"
    return (
        F.when(plain == "", "empty")
        .when(plain.contains(";"), "multiple_statements")
        .when(~plain.rlike("(?i)^(SELECT|WITH)\\s"), "not_select")
        .when(strip_sql(plain).rlike(words), "forbidden_keyword")
        .otherwise("safe")
    )


def unnormalised_literals(c: Column, columns: list[str]) -> Column:
    """Literals compared with a text column directly that are not lower case and trimmed."""
    names = "|".join(columns)
    found = F.regexp_extract_all(c, F.lit(f"(?i)\\b(?:{names})\\b\\s*(?:=|<>|!=)\\s*'([^']*)'"), F.lit(1))
    return F.filter(found, lambda v: v != F.lower(F.trim(v)))


def missing_fields(question: Column, columns: Column, expected: dict[str, list[str]]) -> Column:
    """Of the fields that words of the question ask for, those that no result column's name holds."""
    words = fold_words(question)
    wanted = F.filter(F.array(*[F.when(reduce(lambda a, b: a | b, [words.contains(t) for t in terms]), F.lit(f)) for f, terms in expected.items()]), lambda x: x.isNotNull())
    return F.filter(wanted, lambda f: ~F.exists(columns, lambda c: F.contains(F.lower(c), f)))


def error_class(error: Column, guard_status: Column | None = None, unclear: Column | None = None) -> Column:
    """Class of a run's error; the first rule that matches.  ``unclear`` marks runs that asked back."""
    e = F.lower(F.coalesce(error, F.lit("")))

    def holds(*terms: str) -> Column:
        return reduce(lambda a, b: a | b, [e.contains(t) for t in terms])

    blocked = F.coalesce(guard_status == "blocked", F.lit(False)) if guard_status is not None else F.lit(False)
    return (
        F.when(blocked | holds("guard", "read-only", "readonly", "not allowed"), "sql_guard")
        .when(holds("trino"), "trino")
        .when(holds("groq", "llm", "openai", "api key", "rate limit"), "llm")
        .when(holds("persistence failed"), "persistence")
        .when(holds("metadata"), "metadata")
        .when(F.coalesce(unclear, F.lit(False)) if unclear is not None else F.lit(False), "validation")
        .when(e == "", "unknown")
        .otherwise("other")
    )


def table_kind(c: Column) -> Column:
    """fact, dimension, summary or semantic, by the name without its namespace."""
    short = F.lower(F.element_at(F.split(c, "\\."), -1))
    return F.when(short.startswith("fact_"), "fact").when(short.startswith("dim_"), "dimension").when(short.contains("summary"), "summary").otherwise("semantic")


def session_title(c: Column, most: int = 80) -> Column:
    """Blanks squeezed; long questions cut and closed with three dots."""
    t = F.trim(F.regexp_replace(c, "\\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def anchor_phrases(c: Column, anchors: list[str], stop: list[str], most: int = 3) -> Column:
    """Growing prefixes (up to ``most`` words) after each anchor phrase; a stop word or a word with
    digits ends them; distinct, in order."""

    def good(word: Column) -> Column:
        return ~word.isin(*stop) & ~word.rlike("^[0-9]+$") & (word != "")

    def found(words: Column) -> Column:
        def ends(i: Column) -> Column:
            """Where the anchors that begin at a word end."""
            sizes = {a: a.count(" ") + 1 for a in anchors}
            met = [F.when(F.array_join(F.slice(words, i + 1, F.lit(n)), " ") == a, i + n) for a, n in sizes.items()]
            return F.filter(F.array(*met), lambda x: x.isNotNull())

        def phrases(i: Column) -> Column:
            after = F.slice(words, i + 1, F.lit(most))
            grown = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (n <= F.size(after)) & F.forall(F.slice(after, F.lit(1), n), good))
            return F.transform(grown, lambda n: F.array_join(F.slice(after, F.lit(1), n), " "))

        places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
        return F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(places, ends)), phrases)))

    # an array of one, so that the words are named once: the folding is long, and each place would hold it anew
    return F.get(F.transform(F.array(F.split(fold_words(c), " ")), found), F.lit(0))
