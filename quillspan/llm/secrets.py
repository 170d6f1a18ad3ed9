"""Secret scans: named patterns, and a battery of randomness tests under false-discovery control.

Method: every token of MIN_TOKEN characters or more that mixes letters and digits is a candidate. Its encoding is inferred
from its characters; under that alphabet it takes chi-squared tests of uniformity, over the single characters and over their
kinds, a runs test and a serial-correlation test, combined by the least p-value (Sidak). Each p-value asks whether the token could be a uniform random string.

False discoveries are controlled on both sides, over the whole corpus, per encoding and length class: length-aware, as long
tokens are held against long ones, which have more power. Benjamini-Hochberg marks the tokens that are not random. Of what
stands, the share that is not random either is estimated: random tokens have uniform p-values, so twice those above 1/2 tell
how many there are, and what a cut lets through beyond their part is false. The least cut whose false share is within the
same rate holds; tokens above both cuts are reported as kind ``random``. Native Spark expressions throughout.

Defined cases: a null or empty text has no spans; copies of a text all report; an empty table gives an empty result.
A token whose characters lie all in one half of its alphabet, or are all alike, fails the runs test outright.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import settle, table, text_of

#: Java spells of the base patterns: kind, pattern, the group whose length counts, least length. Order breaks ties of start.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # a run of 32 or more: the same as all runs, then those of 32 or more
)
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}"
FDR = 0.05
#: Spans whose positions are added up together: the work per span is linear in it.
STRETCH = 256
#: p-values above 1/2 fill the bins up to this one.
HALF_BIN = 2
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from narrow to wide: name, what all characters match, alphabet in code order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"), ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"), ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER), ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER), ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"), ("base64url", "^.*$", UPPER + LOWER + DIGITS + "-_+/"),
)
#: Kinds of characters, whose shares are tested beside those of the single ones: few cells, so that short tokens tell too.
CLASSES = ("[0-9]", "[a-z]", "[A-Z]", "[-+/_]")
SPAN = "array<struct<start:int,end:int,size:int>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, length of the group), in code points.

    The pieces between matches and the matches alternate, so their running lengths give the positions: first within stretches
    of STRETCH matches, then from stretch to stretch, so that no array grows by one element per match. The regex runs once
    more as a filter, which spares most texts the rest."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    matches = F.zip_with(found, sizes, lambda m, g: F.struct(F.char_length(m).alias("m"), F.char_length(g).alias("g")))
    steps = F.filter(F.zip_with(matches, F.transform(gaps, lambda x: F.char_length(x)), lambda m, gap: F.struct(gap.alias("gap"), m["m"].alias("m"), m["g"].alias("g"))), lambda x: x["m"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        one = F.struct(s.alias("start"), (s + x["m"]).alias("end"), x["g"].alias("size"))
        return F.struct((s + x["m"]).alias("at"), F.concat(a["spans"], F.array(one)).alias("spans"))

    def stretches(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(all_), F.lit(STRETCH))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(all_, i, F.lit(STRETCH)), start, step))

    def moved(parts: Column) -> Column:
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["at"])))
        shift = lambda p, by: F.transform(p["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["size"].alias("size")))
        return let(begins, lambda by: F.flatten(F.transform(parts, lambda p, i: shift(p, F.get(by, i)))))

    none = F.expr(f"cast(array() as {SPAN})")
    return F.when(text.rlike(pattern), let(steps, lambda all_: let(stretches(all_), moved))).otherwise(none)


def base_spans(text: Column) -> dict[str, Column]:
    def long_enough(least: int):
        return lambda s: s["size"] >= least

    return {kind: F.filter(spans_of(text, pattern, group), long_enough(least)) for kind, pattern, group, least in BASE}


def labelled(kind: str, order: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


#: Coefficients of the normal tail (Abramowitz and Stegun 26.2.17).
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution: absolute error under 1e-7 up to 5, the asymptotic series beyond it."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / F.lit((2 * math.pi) ** 0.5)
    t = 1 / (1 + 0.2316419 * x)
    near = F.lit(0.0)
    for c in reversed(TAIL):
        near = (near + c) * t
    q = 1 / (x * x)
    upper = density * F.when(x < 5, near).otherwise((1 - q * (1 - 3 * q * (1 - 5 * q))) / x)
    return F.when(z < 0, 1 - upper).otherwise(upper)


def encoding_of(token: Column) -> Column:
    out = F.lit(ENCODINGS[-1][0])
    for name, pattern, _ in reversed(ENCODINGS[:-1]):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def test_tokens(tokens: DataFrame, token: str = "_token") -> DataFrame:
    """Adds _enc, _n, _p (combined), _stratum, _bin: bin b holds p in (10^-(b+1)/10, 10^-b/10]."""
    alphabet = F.lit("")
    for name, _, letters in ENCODINGS:
        alphabet = F.when(F.col("_enc") == name, F.lit(letters)).otherwise(alphabet)
    t = tokens.withColumn("_enc", encoding_of(F.col(token))).withColumn("_n", F.char_length(token).cast("double")).withColumn("_alpha", alphabet).withColumn("_k", F.char_length("_alpha").cast("double"))
    t = t.withColumn("_v", F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.position(c, F.col("_alpha")).cast("double") - 1))
    squares = F.aggregate(F.array_distinct("_v"), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter("_v", lambda y: y == x)).cast("double"), F.lit(2.0)))
    low = F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.when(x < F.col("_k") / 2, 1.0).otherwise(0.0))
    after = F.slice("_v", 2, F.size("_v"))
    pairs = F.filter(F.zip_with(F.col("_v"), after, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["y"].isNotNull())
    t = t.withColumn("_sq", squares).withColumn("_low", low).withColumn("_pairs", pairs).withColumn("_mean", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("_n"))
    changes = F.aggregate("_pairs", F.lit(1.0), lambda a, p: a + F.when((p["x"] < F.col("_k") / 2) != (p["y"] < F.col("_k") / 2), 1.0).otherwise(0.0))
    co = F.aggregate("_pairs", F.lit(0.0), lambda a, p: a + (p["x"] - F.col("_mean")) * (p["y"] - F.col("_mean")))
    var = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    t = t.withColumn("_runs", changes).withColumn("_co", co).withColumn("_var", var)

    spread = [F.lit(0.0)] * len(CLASSES)
    for name, _, letters in ENCODINGS:
        for i, kind in enumerate(CLASSES):
            spread[i] = F.when(F.col("_enc") == name, len(re.findall(kind, letters)) / len(letters)).otherwise(spread[i])
    t = t.withColumns({f"_share{i}": c for i, c in enumerate(spread)} | {f"_held{i}": F.char_length(F.regexp_replace(token, f"(?!{c}).", "")) for i, c in enumerate(CLASSES)})

    # Each step's results are columns that the next one reads: its expressions would repeat them many times over.
    n, k, high = F.col("_n"), F.col("_k"), F.col("_n") - F.col("_low")
    kinds, cells = F.lit(-1.0), F.lit(0.0)
    for i in range(len(CLASSES)):
        expected = n * F.col(f"_share{i}")
        cells = cells + F.when(expected > 0, F.pow(F.col(f"_held{i}") - expected, F.lit(2.0)) / expected).otherwise(0.0)
        kinds = kinds + (F.col(f"_share{i}") > 0).cast("double")
    mu = 2 * F.col("_low") * high / n + 1
    t = t.withColumns({"_chi": F.greatest(F.col("_sq") * k / n - n, F.lit(0.0)), "_df": k - 1, "_chi_kinds": cells, "_df_kinds": kinds, "_mu": mu, "_high": high})
    normal = lambda chi, df: (F.cbrt(F.col(chi) / F.col(df)) - (1 - 2 / (9 * F.col(df)))) / F.sqrt(2 / (9 * F.col(df)))
    z_runs = F.when((F.col("_low") == 0) | (F.col("_high") == 0), 10.0).otherwise(F.abs(F.col("_runs") - F.col("_mu")) / F.sqrt(F.greatest((F.col("_mu") - 1) * (F.col("_mu") - 2) / (n - 1), F.lit(0.05))))
    z_serial = F.when(F.col("_var") == 0, 10.0).otherwise(F.abs(F.col("_co") / F.col("_var") + 1 / n) * F.sqrt(n))
    t = t.withColumns({"_z0": normal("_chi", "_df"), "_z1": normal("_chi_kinds", "_df_kinds"), "_z2": z_runs, "_z3": z_serial})
    t = t.withColumns({f"_p{i}": sides * tail(F.col(f"_z{i}")) for i, sides in enumerate((1, 1, 2, 2))})
    t = t.withColumn("_least", F.least(F.lit(1.0), "_p0", "_p1", "_p2", "_p3"))
    t = t.withColumn("_p", F.when(F.col("_least") < 1e-6, 4 * F.col("_least")).otherwise(1 - F.pow(1 - F.col("_least"), F.lit(4.0))))
    size = F.least(F.floor(F.log2("_n")), F.lit(16)).cast("string")
    return t.withColumn("_stratum", F.concat_ws("/", "_enc", size)).withColumn("_bin", F.least(F.floor(-10 * F.log10(F.greatest("_p", F.lit(1e-40)))), F.lit(400)).cast("int"))


def candidates(text: Column, min_token: int) -> Column:
    """Spans of tokens that mix letters and digits, with the tokens."""
    spans = spans_of(text, TOKEN % min_token)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN % min_token), F.lit(0))
    both = F.zip_with(spans, tokens, lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("token")))
    mixed = F.filter(both, lambda x: x["token"].rlike("[0-9]") & x["token"].rlike("[A-Za-z]"))
    return F.when(text.rlike(TOKEN % min_token), mixed).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,token:string>>)"))


def random_bins(tested: DataFrame, fdr: float) -> dict[str, int]:
    """Per stratum, the number of bins, from the greatest p-values on, that are reported.

    The counts are a row per stratum and bin, pre-aggregated: at most 8 encodings x 17 sizes x 401 bins for any corpus.
    For Benjamini-Hochberg a p-value stands at its bin's upper end, which makes the step-up rule conservative."""
    counts = tested.groupBy("_stratum", "_bin").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy("_stratum")
    down, up = whole.orderBy(F.desc("_bin")), whole.orderBy("_bin")
    ranked = counts.select("_stratum", "_bin", F.lead("_bin").over(up).alias("_next"), F.sum("_c").over(down).alias("_rank"), F.sum("_c").over(up).alias("_above"), F.sum("_c").over(whole).alias("_m"), F.coalesce(F.sum(F.when(F.col("_bin") <= HALF_BIN, F.col("_c"))).over(whole), F.lit(0)).alias("_half"))
    marked = F.pow(F.lit(10.0), -F.col("_bin") / 10.0) <= F.lit(fdr) * F.col("_rank") / F.col("_m")
    random = F.least(F.col("_m").cast("double"), 2.0 * (F.col("_half") + 1))  # with one more, so that few tokens are not none
    cut = F.coalesce(F.pow(F.lit(10.0), -F.col("_next") / 10.0), F.lit(0.0))  # as low as it can be before the next token
    false = F.col("_above") - random * (1 - cut)
    judged = ranked.select("_stratum", "_bin", marked.alias("_marked"), (false <= F.lit(fdr) * F.col("_above")).alias("_good"))
    least = F.min(F.when(F.col("_marked"), F.col("_bin"))).over(whole)
    kept = judged.withColumn("_least", least).where(F.col("_good") & (F.col("_least").isNull() | (F.col("_bin") < F.col("_least"))))
    return {r["_stratum"]: r["_b"] for r in kept.groupBy("_stratum").agg((F.max("_bin") + 1).alias("_b")).collect()}  # 8 x 17 rows at most


def scan_secrets(docs: DataFrame, *, min_token: int = MIN_TOKEN, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, random): ``base`` and ``random`` are arrays of (start, ord, kind, end), in order.

    Two passes over the texts: one counts p-values, one reports. Tokens are exploded for the tests and meet again by row,
    keyed by a row number that is written down before use; documents without candidates take no part in that."""
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    parts = [F.transform(c, labelled(kind, i)) for i, (kind, c) in enumerate(base_spans(F.col("_text")).items())]
    base = F.array_sort(F.concat(*parts))
    rows = settle(source.select(F.monotonically_increasing_id().alias("_row"), "_id", base.alias("_base"), candidates(F.col("_text"), min_token).alias("_cands")))
    tokens = rows.where(F.size("_cands") > 0).select("_row", F.explode("_cands").alias("_c")).select("_row", F.col("_c.start").alias("_s"), F.col("_c.end").alias("_e"), F.col("_c.token").alias("_token"))
    tested = settle(test_tokens(tokens).select("_row", "_s", "_e", "_stratum", "_bin"))
    limits = random_bins(tested, fdr)
    limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])[F.col("_stratum")] if limits else F.lit(0)
    random = tested.where(F.col("_bin") < F.coalesce(limit, F.lit(0))).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("start"), F.lit(len(BASE)).alias("ord"), F.lit("random").alias("kind"), F.col("_e").alias("end")))).alias("_random"))
    out = rows.join(random, "_row", "left")
    return out.select(F.col("_id").alias("doc_id"), F.col("_base").alias("base"), F.coalesce("_random", F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int>>)")).alias("random"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "random"))).alias("spans"))
