"""Chat formatting by quotation linking.

Method: lines are parsed into nested quote levels; quoted passages (runs of lines of one level) and their lines are
normalised and hashed, and joined to the message of the same conversation that first wrote them unquoted; the earlier message
that most quoted characters of level 1 lead to is the one replied to. Conversations come out without quotes, ordered so that
each message follows the one it replies to: by root turn, depth, turn. Native Spark expressions throughout.

Defined cases: a null or empty text has an empty body and links to nothing; a message that quotes nothing is a root of its
own, so a conversation without quotes stays in turn order; quotes of later or unknown messages are removed but not linked;
of equal scores the latest turn wins; a null conv_id is a conversation, a null turn comes first and is never linked;
repeated rows are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import fingerprint, settle, table, text_of

MARKS = r"^[ \t]*(?:>[ \t]?)+"
INTRO = r"(?i)\bwrote:[ \t]*$"


def level_of(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">")))


def normal(line: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(line, r"[ \t\r\n]+", " ")))


def runs(lines: DataFrame) -> DataFrame:
    """(_row, _conv, _turn, _level, _text): each maximal run of lines of one level, and each of its lines; blank lines end a run."""
    w = Window.partitionBy("_row").orderBy("_pos")
    before = F.lag("_level").over(w)
    numbered = lines.withColumn("_new", F.when(before.eqNullSafe(F.col("_level")) & (F.lag("_norm").over(w) != "") & (F.col("_norm") != ""), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    solid = numbered.where(F.col("_norm") != "")
    whole = solid.groupBy("_row", "_conv", "_turn", "_level", "_run").agg(F.count("*").alias("_n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_norm"))), lambda s: s["_norm"]), " ").alias("_text"))
    return whole.where("_n > 1").select("_row", "_conv", "_turn", "_level", "_text", F.lit(True).alias("_whole")).unionByName(solid.select("_row", "_conv", "_turn", "_level", F.col("_norm").alias("_text"), F.lit(False).alias("_whole")))


def link_quotes(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, n_quoted, n_linked, parent_turn, root_turn, depth), sorted in reply order within partitions.

    Originals are pre-aggregated to the first turn of each (conversation, hash), so a passage that everybody repeats is one
    row to join; quoted rows of a hot passage can be split by AQE. Roots are found by doubling, in log(depth) joins."""
    rows = settle(messages.select(F.monotonically_increasing_id().alias("_row"), F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), text_of(text_col).alias("_text")))
    lines = rows.select("_row", "_conv", "_turn", F.posexplode(F.split("_text", r"\r?\n", -1)).alias("_pos", "_line"))
    lines = lines.select("_row", "_conv", "_turn", "_pos", level_of(F.col("_line")).alias("_level"), normal(F.regexp_replace("_line", MARKS, "")).alias("_norm"))
    h1, h2 = fingerprint(F.col("_text"))
    units = settle(runs(lines).select("_row", "_conv", "_turn", "_level", "_whole", F.char_length("_text").alias("_len"), h1.alias("_h1"), h2.alias("_h2")))
    originals = units.where("_level = 0").groupBy(F.col("_conv").alias("_oconv"), F.col("_h1").alias("_o1"), F.col("_h2").alias("_o2")).agg(F.min("_turn").alias("_from"))
    quoted = units.where("_level > 0")
    met = quoted.join(originals, F.col("_conv").eqNullSafe(F.col("_oconv")) & (F.col("_h1") == F.col("_o1")) & (F.col("_h2") == F.col("_o2")) & (F.col("_from") < F.col("_turn")), "left")
    met = settle(met.select("_row", "_conv", "_turn", "_level", "_whole", "_len", "_from"))
    counts = met.where("not _whole").groupBy("_row").agg(F.count("*").alias("_nq"), F.count("_from").alias("_nl"))
    scores = met.where("_level = 1 and _from is not null").groupBy("_row", "_conv", "_turn", "_from").agg(F.sum("_len").alias("_score"))
    parents = scores.groupBy("_row", "_conv", "_turn").agg(F.max_by("_from", F.struct("_score", "_from")).alias("_parent"))
    parents = settle(parents)

    # A message that stands in several rows takes its latest parent for the way to its root.
    up = parents.groupBy("_conv", "_turn").agg(F.max("_parent").alias("_up")).select("_conv", "_turn", "_up", F.lit(1).cast("long").alias("_depth"))
    up = settle(up)
    while True:
        above = up.select(F.col("_conv").alias("_aconv"), F.col("_turn").alias("_aturn"), F.col("_up").alias("_aup"), F.col("_depth").alias("_adepth"))
        joined = up.join(above, F.col("_conv").eqNullSafe(F.col("_aconv")) & (F.col("_up") == F.col("_aturn")), "left")
        up = settle(joined.select("_conv", "_turn", F.coalesce("_aup", "_up").alias("_up"), (F.col("_depth") + F.coalesce("_adepth", F.lit(0))).alias("_depth"), F.col("_aup").isNotNull().alias("_more")))
        if not up.where("_more").limit(1).count():
            break
        up = up.drop("_more")
    up = up.select(F.col("_conv").alias("_uconv"), F.col("_turn").alias("_uturn"), F.col("_up").alias("_root"), "_depth")

    cut = F.split("_text", r"\r?\n", -1)
    levels = F.transform(cut, lambda x: F.struct(x.alias("line"), level_of(x).alias("level")))
    own = F.filter(levels, lambda x, i: (x["level"] == 0) & ~(x["line"].rlike(INTRO) & (F.coalesce(F.get(levels, i + 1)["level"], F.lit(0)) > 0)))
    body = F.when(F.col("_text").rlike("(?m)^[ \t]*>"), F.btrim(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), F.lit("\n"))).otherwise(F.col("_text"))
    out = rows.select("_row", "_conv", "_turn", "_role", body.alias("_body"))
    out = out.join(counts, "_row", "left").join(parents.select("_row", "_parent"), "_row", "left")
    out = out.join(up, F.col("_conv").eqNullSafe(F.col("_uconv")) & (F.col("_turn") == F.col("_uturn")), "left")
    out = out.select(
        F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_body").alias("body"),
        F.coalesce("_nq", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("_nl", F.lit(0)).cast("long").alias("n_linked"),
        F.col("_parent").alias("parent_turn"), F.coalesce("_root", "_turn").alias("root_turn"), F.coalesce("_depth", F.lit(0)).cast("long").alias("depth"),
    )
    return out.repartitionByRange("conv_id", "root_turn", "depth", "turn").sortWithinPartitions("conv_id", "root_turn", "depth", "turn")


def op2_quote_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


#: The same in SQL, over the texts of the passages themselves instead of their hashes.
SQL = r"""
WITH RECURSIVE msgs AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), cut AS (
  SELECT r, conv_id, turn, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM (SELECT *, string_split_regex(text, '\r?\n') AS parts FROM msgs)
), marked AS (
  SELECT *, regexp_extract(line, '^[ \t]*(?:>[ \t]?)+') AS marks FROM cut
), lines AS (
  SELECT r, conv_id, turn, pos, line, length(marks) - length(replace(marks, '>', '')) AS lev,
         lower(trim(regexp_replace(substr(line, length(marks) + 1), '[ \t\r\n]+', ' ', 'g'), ' ')) AS norm FROM marked
), stepped AS (
  SELECT *, CASE WHEN lag(lev) OVER w = lev AND lag(norm) OVER w <> '' AND norm <> '' THEN 0 ELSE 1 END AS fresh FROM lines WINDOW w AS (PARTITION BY r ORDER BY pos)
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY pos) AS run FROM stepped
), units AS (
  SELECT r, conv_id, turn, lev, true AS whole, string_agg(norm, ' ' ORDER BY pos) AS passage FROM runs WHERE norm <> '' GROUP BY r, conv_id, turn, lev, run HAVING count(*) > 1
  UNION ALL SELECT r, conv_id, turn, lev, false, norm FROM runs WHERE norm <> ''
), originals AS (
  SELECT conv_id, passage, min(turn) AS origin FROM units WHERE lev = 0 GROUP BY ALL
), met AS (
  SELECT u.r, u.conv_id, u.turn, u.lev, u.whole, length(u.passage) AS len, o.origin
  FROM units u LEFT JOIN originals o ON u.conv_id IS NOT DISTINCT FROM o.conv_id AND u.passage = o.passage AND o.origin < u.turn WHERE u.lev > 0
), counts AS (
  SELECT r, count(*) AS n_quoted, count(origin) AS n_linked FROM met WHERE NOT whole GROUP BY r
), scores AS (
  SELECT r, conv_id, turn, origin, sum(len) AS score FROM met WHERE lev = 1 AND origin IS NOT NULL GROUP BY ALL
), parents AS (
  SELECT r, conv_id, turn, origin AS parent FROM scores QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, origin DESC) = 1
), ups AS (
  SELECT conv_id, turn, max(parent) AS up FROM parents GROUP BY ALL
), climb AS (
  SELECT conv_id, turn, up AS top, 1 AS depth FROM ups
  UNION ALL SELECT c.conv_id, c.turn, u.up, c.depth + 1 FROM climb c JOIN ups u ON c.conv_id IS NOT DISTINCT FROM u.conv_id AND c.top = u.turn
), roots AS (
  SELECT conv_id, turn, min_by(top, -depth) AS root, max(depth) AS depth FROM climb GROUP BY ALL
), bodies AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE own) AS body FROM (
    SELECT *, lev = 0 AND NOT (regexp_matches(line, '(?i)\bwrote:[ \t]*$') AND coalesce(lead(lev) OVER (PARTITION BY r ORDER BY pos), 0) > 0) AS own FROM lines) GROUP BY r
)
SELECT m.conv_id, m.turn, m.role, CASE WHEN regexp_matches(m.text, '(?m)^[ \t]*>') THEN trim(coalesce(b.body, ''), chr(10)) ELSE m.text END AS body,
       coalesce(c.n_quoted, 0)::BIGINT AS n_quoted, coalesce(c.n_linked, 0)::BIGINT AS n_linked, p.parent AS parent_turn,
       coalesce(t.root, m.turn) AS root_turn, coalesce(t.depth, 0)::BIGINT AS depth
FROM msgs m LEFT JOIN bodies b ON m.r = b.r LEFT JOIN counts c ON m.r = c.r LEFT JOIN parents p ON m.r = p.r
LEFT JOIN roots t ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.turn = t.turn
"""
