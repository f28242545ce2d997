"""Quality rules in DataFrame functions only: base statistics, and divergence from language references.

A reference of a language is the mix of character classes and of its commonest words over all its documents; a pooled
one over all documents serves null and rare languages. A document fails if the
Jensen-Shannon distance of its own mix from the reference exceeds a bound, and short texts, whose mixes are chance, are
guarded by least lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorra.llm.common import WORD, as_long, saved

#: Words of a reference histogram.
COMMON = 24
#: Character classes: upper case, other letters, digits, white space, sentence marks, anything else.
CLASSES = ("upper", "letter", "digit", "space", "mark", "other")
#: Largest Jensen-Shannon distance (base 2, 0 to 1) from the reference: character classes, common words.
MOST_CLASS, MOST_WORD = 0.30, 0.42
#: Least characters and words for each comparison.
LEAST_CHARS, LEAST_WORDS = 200, 40
#: Languages with fewer documents use the pooled reference.
LEAST_DOCS = 20
WINDOW = 5


def _kept(text: Column, pattern: str) -> Column:
    """text without what the pattern matches."""
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def _points(text: Column) -> Column:
    return F.length(text).cast("long")


def words_of(text: Column) -> Column:
    """The words of a text, in order; null: none. Plain replacing and splitting, which cost a fraction of a pattern."""
    body = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        body = F.replace(body, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(body, " "), "")


def _repeat_words() -> Column:
    """Words in windows of WINDOW words that the text holds twice or more, from the columns hashes and sorted."""
    twin = lambda e, k: (F.get(F.col("sorted"), k - 1)["h"].eqNullSafe(e["h"])) | (F.get(F.col("sorted"), k + 1)["h"].eqNullSafe(e["h"]))
    return F.sort_array(F.transform(F.filter(F.col("sorted"), twin), lambda e: e["i"]))


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with words (array), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_n; null text: none.

    class_n has the code points of each of CLASSES, in order.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    # every pattern reads what the one before has left: letters are most of a text, the rest is short
    out = out.withColumn("solid", F.array_join("words", "")).withColumn("word_chars", _points(F.col("solid")))
    out = out.withColumn("signs", _kept(F.col("solid"), r"\p{L}+"))
    out = out.withColumn("others", _kept(F.col("signs"), r"\p{N}+"))
    letters, n_signs, n_others = F.col("word_chars") - _points(F.col("signs")), _points(F.col("signs")), _points(F.col("others"))
    upper = F.col("word_chars") - _points(_kept(F.col("solid"), r"\p{Lu}+"))
    unmarked = _points(_kept(F.col("others"), r"""[.,;:!?'"()\-]+"""))
    out = out.withColumn("n_symbols", n_others - _points(_kept(F.col("others"), r"[#*$%&|<>]+")))
    out = out.withColumn("class_n", F.array(upper, letters - upper, n_signs - n_others, _points(body) - F.col("word_chars"), n_others - unmarked, unmarked))
    out = out.drop("solid", "signs", "others")
    out = out.withColumn("lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # a window's hash is made of pairs: of the hashes of two words, of two pairs, of four words and the fifth
    both = lambda x, y, start: F.zip_with(x, F.slice(y, F.lit(start), F.size("hashed")), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    out = out.withColumn("pairs", both(F.col("hashed"), F.col("hashed"), 2))
    fives = both(both(F.col("pairs"), F.col("pairs"), 3), F.col("hashed"), WINDOW)
    out = out.withColumn("hashes", F.slice(fives, F.lit(1), F.greatest(F.lit(0), F.size("hashed") - (WINDOW - 1)))).drop("hashed", "pairs")
    # only texts with an equal pair of windows are sorted
    pairs = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(pairs)).otherwise(nothing)).drop("hashes")
    out = out.withColumn("at", _repeat_words()).drop("sorted")
    steps = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1), p + WINDOW) - p))
    out = out.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("at")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def common_words(docs: DataFrame) -> DataFrame:
    """(key, common, n): the COMMON commonest words and their counts, for each lang of LEAST_DOCS documents and pooled.

    key is the lang after an "l", or "p" for all documents pooled. A language without words has no row.
    """
    langs = docs.groupBy("lang").count().where(F.col("lang").isNotNull() & (F.col("count") >= LEAST_DOCS)).select("lang")
    words = docs.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = saved(words, "reference-words")

    def top(counted: DataFrame) -> DataFrame:
        first = counted.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "word"))).where(F.col("r") <= COMMON)
        listed = F.sort_array(F.collect_list(F.struct("r", "word", "n")))
        return first.groupBy("key").agg(listed.alias("x"))

    own = words.join(langs, "lang").select(F.concat(F.lit("l"), "lang").alias("key"), "word", "n")
    every = words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").select(F.lit("p").alias("key"), "word", "n")
    both = top(own.where("n > 1")).unionByName(top(every))
    return both.select("key", F.transform("x", lambda e: e["word"]).alias("common"), F.transform("x", lambda e: e["n"]).alias("n"))


def references(measured: DataFrame, common: DataFrame) -> DataFrame:
    """(key, classes, shares) of measured(lang, class_n, n_words): probabilities for each lang of LEAST_DOCS documents and pooled.

    shares belong to the common words, in order, then to all others.
    """
    sums = [F.sum(F.get("class_n", F.lit(k))).alias(c) for k, c in enumerate(CLASSES)]
    each = saved(measured.groupBy("lang").agg(*sums, F.sum("n_words").alias("total"), F.count("*").alias("docs")), "reference-classes")
    mixes = each.where((F.col("docs") >= LEAST_DOCS) & F.col("lang").isNotNull()).select(F.concat(F.lit("l"), "lang").alias("key"), *CLASSES, "total")
    mixes = mixes.unionByName(each.agg(*[F.sum(c).alias(c) for c in (*CLASSES, "total")]).select(F.lit("p").alias("key"), *CLASSES, "total"))
    all_chars = F.greatest(sum((F.coalesce(F.col(c), F.lit(0)) for c in CLASSES), F.lit(0)), F.lit(1))
    classes = F.array(*[F.coalesce(F.col(c), F.lit(0)) / all_chars for c in CLASSES])
    n = F.coalesce(F.col("n"), F.array().cast("array<bigint>"))
    all_words = F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))
    shares = F.concat(F.transform(n, lambda k: k / all_words), F.array(F.lit(1.0) - F.aggregate(n, F.lit(0).cast("long"), lambda a, k: a + k) / all_words))
    return mixes.join(common, "key", "left").select("key", classes.alias("classes"), shares.alias("shares"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence, base 2, of two probability arrays of one length."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """docs' columns, the base statistics, class_distance and word_distance (null where guarded), base_failed and kept.

    docs has doc_id, text, lang. Null texts have no words and fail; null langs and langs of few documents are held
    against the pooled reference. Repeated rows each get a verdict; all rows count for the references. Columns whose
    names clash with a result are replaced. Empty table: empty result.
    """
    made = ["words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_n", "class_distance", "word_distance", "kept"]
    keep = [c for c in docs.columns if c not in made]
    return judged(docs.select(*keep), keep)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs and the results of quality_rules; docs has text and lang, which need not be kept.

    The texts are read twice: for the counts of words, and for all statistics, which are saved; a language's mix
    of classes and the verdicts come from these.
    """
    common = saved(common_words(docs), "reference-common")
    counted = docs.groupBy("lang").count().where(F.col("lang").isNotNull() & (F.col("count") >= LEAST_DOCS))
    large = saved(counted.select(F.concat(F.lit("l"), "lang").alias("large")), "reference-langs")
    mine = F.concat(F.lit("l"), "lang")
    rows = base_statistics(docs.select(F.struct(*keep).alias("kept_columns"), "lang", "text")).drop("text")
    # a row a language, written, so that Spark knows their size and broadcasts them if it is small; the pool is one row
    own = common.select(F.col("key").alias("own"), F.col("common").alias("own_common"))
    pool = F.broadcast(common.where("key = 'p'").select(F.col("common").alias("pool_common")))
    rows = rows.join(large, mine == F.col("large"), "left").join(own, F.col("large") == F.col("own"), "left").join(pool, F.lit(True), "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("key", F.coalesce("large", F.lit("p")))
    rows = rows.withColumn("common", F.coalesce(F.when(F.col("large").isNotNull(), F.col("own_common")).otherwise(F.col("pool_common")), none))
    size = F.size("words")
    # the places of the common words among the words, then how often each place occurs; the places are bound to
    # a lambda variable, since a column that only a lambda reads is folded into it and made anew for every k
    places = F.filter(F.transform("words", lambda w: F.array_position("common", w)), lambda p: p > 0)
    often = lambda p: F.transform(F.sequence(F.lit(1), F.size("common")), lambda k: (F.size(p) - F.size(F.array_remove(p, k.cast("long")))).cast("double"))
    bins = F.get(F.transform(F.array(places), often), F.lit(0))
    rows = rows.withColumn("bins", F.when(F.size("common") > 0, bins).otherwise(F.array().cast("array<double>")))
    rest = size - F.aggregate("bins", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("mix", F.transform(F.concat("bins", F.array(rest)), lambda x: x / F.greatest(size, F.lit(1))))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    measured = saved(rows.select("kept_columns", "lang", "key", "class_n", "mix", *stats, "base_failed"), "measured")
    joined = measured.join(saved(references(measured, common), "references"), "key", "left")  # again a row a language
    chars = F.aggregate("class_n", F.lit(0).cast("long"), lambda a, x: a + x)
    classes = F.transform("class_n", lambda x: x / F.greatest(chars, F.lit(1)))
    joined = joined.withColumn("class_distance", F.when(chars >= LEAST_CHARS, js_distance(classes, F.col("classes"))))
    joined = joined.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, js_distance(F.col("mix"), F.col("shares"))))
    far = F.coalesce(F.col("class_distance") > MOST_CLASS, F.lit(False)) | F.coalesce(F.col("word_distance") > MOST_WORD, F.lit(False))
    joined = joined.withColumn("kept", ~F.col("base_failed") & ~far)
    return joined.select(*[F.col("kept_columns").getField(c).alias(c) for c in keep], *stats, "class_distance", "word_distance", "base_failed", "kept")


def op8(docs: DataFrame) -> DataFrame:
    rows = judged(docs.select(as_long(F.col("doc_id")).alias("doc_id"), "text", "lang"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 4).alias("class_distance"), F.round("word_distance", 4).alias("word_distance"))


#: The same rows in DuckDB, one row a word, window and histogram bin.
OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
large AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
k AS MATERIALIZED (SELECT d.*, CASE WHEN large.lang IS NULL THEN 'p' ELSE 'l' || large.lang END AS key, string_split(t, chr(10)) AS lines, array_to_string(w, '') AS solid FROM d LEFT JOIN large ON large.lang = d.lang),
ls AS MATERIALIZED (SELECT row, unnest(lines) AS line FROM k),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM ls WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
win AS MATERIALIZED (SELECT row, i, w[i : i + 4] AS x FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM k WHERE len(w) >= 5)),
hit AS (SELECT row, i FROM win QUALIFY count(*) OVER (PARTITION BY row, x) > 1),
rep AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM hit, range(5) r(j) GROUP BY row),
cl AS MATERIALIZED (SELECT row, key, c, unnest([
    length(regexp_replace(solid, '[^\p{Lu}]', '', 'g')), length(regexp_replace(solid, '[^\p{L}]', '', 'g')) - length(regexp_replace(solid, '[^\p{Lu}]', '', 'g')), length(regexp_replace(solid, '[^\p{N}]', '', 'g')),
    length(t) - length(solid), length(regexp_replace(solid, '[^.,;:!?''"()\-]', '', 'g')), length(regexp_replace(solid, '[\p{L}\p{N}.,;:!?''"()\-]', '', 'g'))]) AS n, unnest(range(6)) AS bin FROM (SELECT *, length(t) AS c FROM k)),
cref AS MATERIALIZED (SELECT key, bin, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY key), 1) AS q FROM (SELECT key, bin, n FROM cl WHERE key <> 'p' UNION ALL SELECT 'p', bin, n FROM cl) GROUP BY key, bin),
each AS MATERIALIZED (SELECT row, key, unnest(w) AS word FROM k),
cnt AS MATERIALIZED (SELECT key, word, count(*) AS n FROM (SELECT key, word FROM each WHERE key <> 'p' UNION ALL SELECT 'p', word FROM each) GROUP BY key, word),
tot AS (SELECT key, sum(n) AS total FROM cnt GROUP BY key),
top AS MATERIALIZED (SELECT key, word, n / total AS q FROM cnt JOIN tot USING (key) WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, word) <= 24),
own AS (SELECT row, key, word, count(*) AS n FROM each GROUP BY row, key, word),
bins AS MATERIALIZED (SELECT k.row, top.q, coalesce(own.n, 0) / greatest(len(k.w), 1) AS p FROM k JOIN top ON top.key = k.key LEFT JOIN own ON own.row = k.row AND own.word = top.word),
rest AS (SELECT k.row, 1 - coalesce(any_value(s.q), 0) AS q, CASE WHEN any_value(len(k.w)) > 0 THEN 1 - coalesce(any_value(s.p), 0) ELSE 0 END AS p FROM k LEFT JOIN (SELECT row, sum(q) AS q, sum(p) AS p FROM bins GROUP BY row) s USING (row) GROUP BY k.row),
js AS (SELECT row, kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS d FROM (
  SELECT row, 'w' AS kind, p, q FROM bins UNION ALL SELECT row, 'w', p, q FROM rest
  UNION ALL SELECT row, 'c', n / greatest(sum(n) OVER (PARTITION BY row), 1), q FROM cl JOIN cref USING (key, bin)) GROUP BY row, kind),
a AS (SELECT k.row, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(solid) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  CASE WHEN length(t) >= 200 THEN c.d END AS class_distance, CASE WHEN len(w) >= 40 THEN v.d END AS word_distance
  FROM k LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) JOIN js c ON c.row = k.row AND c.kind = 'c' JOIN js v ON v.row = k.row AND v.kind = 'w')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(class_distance, 0) <= 0.30 AND coalesce(word_distance, 0) <= 0.42 AS kept,
  round(class_distance, 4) AS class_distance, round(word_distance, 4) AS word_distance FROM a
"""
