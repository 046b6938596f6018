"""Secret scan in DataFrame functions only.

Base kinds are patterns: ``assign`` (a named credential and its value), ``access``
(access key ids) and ``hex`` (long runs of hexadecimal digits). A match's place
follows from the text around the matches: the pieces that ``split`` leaves and
the matches themselves add up to code-point offsets.

The kind ``random`` adds strings that look drawn at random, by a battery of
tests on every run of 20 or more letters, digits and ``+/_-``:

* the encoding is inferred from the characters (hex, base 32, lower- or
  upper-case alphanumeric, base 64) and gives the alphabet of k symbols;
* chi-squared of the symbol counts against uniformity, a runs test above and
  below the alphabet's middle, and lag-one serial correlation; their p-values
  (normal approximations) are combined by Bonferroni. A string that fails at
  ``REJECT`` is not random;
* against ordinary text speaks how often neighbours change character class: a
  Chernoff bound of the binomial tail at ``TEXT_CHANGE``, which shrinks with the
  length. Benjamini-Hochberg over the document's candidates at ``FDR`` decides.

Random spans that touch a base span are left out.

Edge cases: null and empty texts have no spans (counts 0, the hash of the empty
string, an empty list); a null id is carried along; repeated rows are scanned
one by one; extra columns are ignored, or kept by ``masked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside

#: The names and patterns of the base kinds.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
VALUE = """["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "random")
ACCESS, HEX, LONG = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9+/_-]{20,}"
MIN_VALUE = 12

FDR, REJECT, TEXT_CHANGE = 0.001, 0.001, 0.1
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern of the whole string, alphabet), first match holds.
ENCODINGS = (("^[0-9a-f]+$", DIGITS + "abcdef"), ("^[0-9A-F]+$", DIGITS + "ABCDEF"), ("^[A-Z2-7]+$", UPPER + "234567"),
             ("^[a-z0-9]+$", DIGITS + LOWER), ("^[A-Z0-9]+$", DIGITS + UPPER), ("", UPPER + LOWER + DIGITS + "+/"))
MASK = "[SECRET]"


def either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = f"(?:{'|'.join(map(either_case, NAMES))}){VALUE}"


def _spans(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """array<struct<s, k, e, v>> of the matches; s and e are code points, v is the match or its group ``value``."""
    empty = F.array().cast("array<struct<s:bigint,k:int,e:bigint,v:string>>")
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else whole
    start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("found"))
    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["found"], F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["v"].alias("v")))).alias("found"))
    rows = F.filter(F.arrays_zip(pieces.alias("p"), whole.alias("m"), values.alias("v")), lambda x: x["m"].isNotNull())
    return F.when(text.rlike(pattern), F.aggregate(rows, start, step)["found"]).otherwise(empty)


def _two_sided(z: Column) -> Column:
    """Two-sided normal p-value (a logistic approximation, within 2e-4)."""
    a = F.least(F.abs(z), F.lit(30.0))
    return F.lit(2.0) / (1.0 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


# What a lambda over the symbols uses must be a field already: an expression would be worked out again for every symbol.


def _spelled(span: Column) -> Column:
    """A candidate with its text in the standard alphabet and the alphabet of its encoding."""
    alphabet = F.coalesce(*[F.when(span["v"].rlike(p) if p else F.lit(True), F.lit(a)) for p, a in ENCODINGS])
    return F.struct(span["s"].alias("s"), span["e"].alias("e"), F.translate(span["v"], "-_", "+/").alias("w"), alphabet.alias("abc"))


def _coded(t: Column) -> Column:
    """A candidate with its length, alphabet size, symbol codes and character classes."""
    codes = F.transform(F.split(t["w"], ""), lambda c: (F.position(c, t["abc"]) - 1).cast("double"))
    kinds = F.split(F.translate(t["w"], UPPER + LOWER + DIGITS + "+/", "U" * 26 + "L" * 26 + "D" * 10 + "SS"), "")
    return F.struct(t["s"].alias("s"), t["e"].alias("e"), F.length(t["w"]).cast("double").alias("n"), F.length(t["abc"]).cast("double").alias("k"),
                    codes.alias("x"), kinds.alias("c"))


def _with_mean(t: Column) -> Column:
    return F.struct(*[t[f].alias(f) for f in ("s", "e", "n", "k", "x", "c")], (_sum(t["x"]) / t["n"]).alias("mean"))


def _judged(t: Column) -> Column:
    """struct<p, s, e, ok>: the p-value against ordinary text, and whether the battery does not reject randomness."""
    n, k, x = t["n"], t["k"], t["x"]
    squares = _sum(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2.0))))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    next_x = F.slice(x, 2, F.size(x) - 1)
    ones = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
    flips = F.size(F.filter(F.zip_with(F.slice(x, 1, F.size(x) - 1), next_x, lambda a, b: (a >= k / 2) != (b >= k / 2)), lambda y: y)).cast("double")
    both = 2 * ones * (n - ones)
    runs_var = both * (both - n) / (n * n * (n - 1))
    runs = F.when(runs_var > 0, (flips + 1 - both / n - 1) / F.sqrt(F.when(runs_var > 0, runs_var).otherwise(1.0))).otherwise(F.lit(30.0))
    mean = t["mean"]
    var = _sum(F.transform(x, lambda v: (v - mean) * (v - mean)))
    lag = _sum(F.zip_with(F.slice(x, 1, F.size(x) - 1), next_x, lambda a, b: (a - mean) * (b - mean)))
    serial = F.when(var > 0, (lag / F.when(var > 0, var).otherwise(1.0) + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
    p_random = 3 * F.least(_two_sided(F.greatest(chi, F.lit(0.0))), _two_sided(runs), _two_sided(serial))
    changes = F.size(F.filter(F.zip_with(F.slice(t["c"], 1, F.size(x) - 1), F.slice(t["c"], 2, F.size(x) - 1), lambda a, b: a != b), lambda y: y)).cast("double")
    rate = changes / (n - 1)
    bound = rate * F.log(F.greatest(rate, F.lit(1e-9)) / TEXT_CHANGE) + (1 - rate) * F.log(F.greatest(1 - rate, F.lit(1e-9)) / (1 - TEXT_CHANGE))
    p_text = F.when(rate > TEXT_CHANGE, F.exp(-(n - 1) * bound)).otherwise(F.lit(1.0))
    return F.struct(p_text.alias("p"), t["s"].alias("s"), t["e"].alias("e"), (p_random >= REJECT).alias("ok"))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_all``: sorted array<struct<s, k, e>> of the base spans and of all spans."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    step = docs.select(*kept, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    step = step.select(*kept, F.array_sort(F.concat(
        F.filter(_spans(F.col("_t"), ASSIGN, 0, 1), lambda x: F.length(x["v"]) >= MIN_VALUE),
        _spans(F.col("_t"), ACCESS, 1), _spans(F.col("_t"), HEX, 2))).alias("_b"), _spans(F.col("_t"), LONG, 3).alias("_r"))
    narrow = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    step = step.select(*kept, F.transform("_b", narrow).alias("_base"), F.transform("_r", _spelled).alias("_r"))
    step = step.select(*kept, "_base", F.transform("_r", _coded).alias("_r"))
    step = step.select(*kept, "_base", F.transform("_r", _with_mean).alias("_r"))
    step = step.select(*kept, "_base", F.array_sort(F.transform("_r", _judged)).alias("_r"))
    # Benjamini-Hochberg: the last rank whose p-value is low enough, and all before it
    size = F.size("_r")
    low = F.transform("_r", lambda x, i: F.when(x["p"] <= F.lit(FDR) * (i + 1) / size, i + 1).otherwise(0))
    step = step.select(*kept, "_base", F.when(size > 0, F.slice("_r", F.lit(1), F.coalesce(F.array_max(low), F.lit(0)))).otherwise(F.col("_r")).alias("_r"))
    free = F.filter("_r", lambda x: x["ok"] & ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    more = F.transform(free, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    return step.select(*kept, "_base", F.array_sort(F.concat("_base", more)).alias("_all"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    found = scanned(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text")), "_text")
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("bigint")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(_listed("_base").cast("binary"), 256).alias("base_sha256"), _listed("_all").alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span of the text replaced by ``MASK`` (overlapping spans by one), and the length brought up to date."""
    plain, name = aside(docs)
    text = F.col(name[text_col])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    def step(acc, x):
        fresh = x["s"] >= acc["at"]
        # a span that begins inside the one before it only moves the end on
        out = F.when(fresh, F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))
    done = F.aggregate("_all", start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    step1 = scanned(plain, name[text_col]).withColumn("_new", F.when(F.size("_all") > 0, done).otherwise(text))
    cols = []
    for c, own in name.items():
        if c == text_col:
            cols.append(F.col("_new").alias(c))
        elif c == length_col:
            cols.append(F.when(F.size("_all") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(F.col(own)).alias(c))
        else:
            cols.append(F.col(own).alias(c))
    return step1.select(*cols)
