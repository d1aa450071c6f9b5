"""Grouping of spelling variants: words one edit apart, found by an index of grams of variable length."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelforge.llm.base import col, query, table
from panelforge.session import durable

# All but A-Z, a-z and U+00C0 to U+00FF, as ranges: far faster than the class negated.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\xBF\x{100}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, FACTOR, DROP = 6, 5, 5, 199
# Grams have 2 to 4 letters; at most so many grams of one length are extended by a letter.
GRAM, LONGEST, NODES = 2, 4, 8192
FIRST, LAST = "\u0002", "\u0003"


def lowered(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the shorter way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def runs(docs: DataFrame, id_: str, text: str, shortest: int = SHORTEST, drop: int = DROP) -> DataFrame:
    """Every run of letters that can give a word of ``shortest`` letters, column ``word``; the drawn ones lose a letter.

    A run is drawn if ``drop`` divides the crc32 of ``<id>:<run>``, a null id
    being empty; the letter is that of the place crc32 % length.
    """
    whole = docs.select(F.coalesce(col(id_).cast("string"), F.lit("")).alias("id"), lowered(F.coalesce(col(text), F.lit(""))).alias("t"))
    # The outer form: for the other the planner tests the size of the array first, and splits every text twice.
    found = whole.select("id", F.explode_outer(F.split("t", BETWEEN)).alias("run")).where(F.char_length("run") >= shortest)
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST,
               drop: int = DROP) -> DataFrame:
    """Words of at least ``shortest`` letters with their number n, at least ``least``, counted over all texts."""
    words = runs(docs, id_, text, shortest, drop).groupBy("word").agg(F.count("*").alias("n"))
    return words.where((F.char_length("word") >= shortest) & (F.col("n") >= least))


def dictionary(words: DataFrame, nodes: int = NODES) -> DataFrame:
    """The grams that are extended: those of 2 and 3 letters that stand at more than 1/``nodes`` of all places.

    A gram of the dictionary is what a walk from some place stops at: rare
    grams stay short, frequent ones grow to four letters. At most ``nodes``
    grams of one length can be that frequent, whatever the vocabulary.
    """
    places = words.agg(F.sum(F.char_length("padded") - 1).alias("n")).first()["n"] or 0
    # The last place holds no three letters.
    grams = F.array(*[F.when(F.col("p") + q - 1 <= F.col("size"), F.substring("padded", F.col("p"), F.lit(q))) for q in range(GRAM, LONGEST)])
    at = words.select("padded", F.char_length("padded").alias("size"), _places())
    counts = at.select(F.explode(grams).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count("*").alias("c"))
    return counts.where(F.col("c") > max(1, places // nodes)).select("gram")


def _places() -> Column:
    return F.explode(F.sequence(F.lit(1), F.char_length("padded") - 1)).alias("p")


def decomposed(words: DataFrame, nodes: int = NODES) -> DataFrame:
    """One row per place of every word: ``(id, p, q, gram)``, the gram of q letters that starts there.

    The walk reads the letters of its gram and no others (a word's end is a
    letter of its own), so an edit changes the grams that cover it, and only
    them.
    """
    extended = durable(dictionary(words, nodes))  # bounded by its construction
    out, longer = words.select("id", "padded", _places()), F.lit(GRAM)
    for q in range(GRAM, LONGEST):
        level = extended.where(F.char_length("gram") == q).select(F.col("gram").alias(f"g{q}"))
        out = out.join(F.broadcast(level), F.substring("padded", F.col("p"), F.lit(q)) == F.col(f"g{q}"), "left")
        longer = longer + F.when(F.col(f"g{q}").isNotNull(), 1).otherwise(0)
    gram = F.substring("padded", F.col("p"), F.col("q"))
    return out.withColumn("q", longer).select("id", "p", F.char_length(gram).alias("q"), gram.alias("gram"))


def affected(sizes: Column) -> Column:
    """The most grams that one edit can change, from the sizes of a word's grams in the order of their places."""
    reach = lambda i: reduce(
        lambda a, b: a + b, [F.when(F.coalesce(F.get(sizes, i - d), F.lit(0)) > d, 1).otherwise(0) for d in range(LONGEST)]
    )
    return F.array_max(F.transform(sizes, lambda _, i: reach(i)))


def prefixes(words: DataFrame, nodes: int = NODES) -> DataFrame:
    """Of every word the rarest grams that a word one edit away must share one of: ``(id, prefix)``.

    An edit changes at most ``affected`` grams, so two near words share all
    but so many of either. In an order of all grams (frequency, letters,
    place), which an edit does not disturb, their first common gram is then
    among the first ``affected`` + 1 of both.
    """
    grams = durable(decomposed(words, nodes))
    counts = durable(grams.groupBy("gram").agg(F.count("*").alias("c")))
    of_word = grams.join(counts, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "gram", "p", "q"))).alias("g"))
    of_word = of_word.withColumn("sizes", F.transform(F.array_sort(F.transform("g", lambda x: F.struct(x["p"], x["q"]))), lambda x: x["q"]))
    return of_word.select("id", F.slice("g", F.lit(1), affected(F.col("sizes")) + 1).alias("prefix"))


def near_pairs(words: DataFrame, nodes: int = NODES) -> DataFrame:
    """Pairs of words one inserted, deleted or replaced letter apart, once each: ``(a, na, b, nb)``.

    The lists of the index go by gram, place and length of the word: a word
    meets those of its length at the same place, and those longer by a letter
    at the same place or the next. Every candidate is verified.
    """
    words = words.where("word is not null").withColumn("padded", F.concat(F.lit(FIRST), "word", F.lit(LAST)))
    words = durable(words.withColumn("id", F.monotonically_increasing_id()))
    found = prefixes(words, nodes).join(words.drop("padded"), "id").withColumn("size", F.char_length("word"))
    found = durable(found.select("word", "n", "size", F.transform("prefix", lambda x: F.struct(x["gram"], x["p"])).alias("prefix")))
    lists = found.select("word", "n", "size", F.explode("prefix").alias("x")).select("word", "n", "size", "x.*")
    index = lists.select(F.xxhash64("gram", "p", "size").alias("key"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("size").alias("sb"))
    keys = F.array(F.xxhash64("gram", "p", "size"), F.xxhash64("gram", "p", F.col("size") + 1), F.xxhash64("gram", F.col("p") + 1, F.col("size") + 1))
    probe = lists.select(F.explode(keys).alias("key"), F.col("word").alias("a"), F.col("n").alias("na"), F.col("size").alias("sa"))
    once = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("a") < F.col("b")))
    pairs = probe.hint("merge").join(index, (probe["key"] == index["key"]) & once & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "na", "b", "nb").distinct()


def variants(words: DataFrame, factor: int = FACTOR, nodes: int = NODES) -> DataFrame:
    """Spelling variants among ``words`` (word, n): ``(word, form, root, n, n_near, form_n)``.

    ``form`` is the near word (one edit away) of largest n, the smallest in
    code-point order of equal ones, if its n is at least ``factor`` times the
    word's, else null; ``root`` is where the forms lead, the word itself
    without any; ``n_near`` counts the near words.

    Words are distinct and have at least four letters (a shorter one raises an
    error: one edit can change all its grams); a null word is left out; no
    words give no rows. Long words are handled whole.
    """
    bounds = words.agg(F.min(F.char_length("word")).alias("short"), F.max("n").alias("n")).first()
    if bounds["short"] is not None and bounds["short"] < LONGEST:
        raise ValueError(f"words need {LONGEST} letters")
    pairs = durable(near_pairs(words, nodes))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), "b")).alias("best"))
    out = words.where("word is not null").join(best, "word", "left")
    leads = -F.col("best.m") >= factor * F.col("n")
    out = durable(out.select(
        "word", F.when(leads, F.col("best.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(leads, -F.col("best.m")).alias("form_n"),
    ))
    # A step multiplies n by the factor, so a path has at most so many; each round doubles the steps taken.
    steps = math.log(max(1, bounds["n"] or 1)) / math.log(max(2, factor)) + 1
    links = durable(out.where("form is not null").select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = durable(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return out.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


@query("op12_spellings", sql=r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(0, 256) r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
long AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
  FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
    lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM long, tab),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2)
    ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, (list(other ORDER BY n DESC, other))[1] AS form FROM near GROUP BY word),
res AS (
  SELECT words.word, CASE WHEN form_n >= 5 * words.n THEN form END AS form, words.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
path AS (
  WITH RECURSIVE p(word, here, form) AS (
    SELECT word, word, form FROM res UNION ALL SELECT p.word, p.form, res.form FROM p JOIN res ON p.form = res.word)
  SELECT word, here FROM p WHERE form IS NULL)
SELECT res.word, res.form, path.here AS root, res.n, res.n_near, res.form_n FROM res JOIN path ON res.word = path.word""")
def op12_spellings(spark, folder):
    """All documents; words of six letters that occur five times."""
    return variants(durable(vocabulary(table(spark, folder, "documents"))))
