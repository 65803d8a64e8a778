"""License scan by diagonal voting, in DataFrame operations only.

All rolling word k-grams of every text are hashed and joined with the positions of the same hashes in a table of
license templates.  A hit at text word p and template word q votes for the diagonal p - q; votes of one text,
template and diagonal are summed.  Diagonals at most ``JOIN`` words apart merge (a word put in or left out shifts
what follows) into bands of at most ``WIDTH`` diagonals, which are laid out twice, half a width apart, so that a
drift of half a width always stands in one band.  Bands with enough different k-grams are then verified word by word
in the texts that have them: a template word counts if the text has it on one of the band's diagonals.  A span needs
``LEAST_WORDS`` verified words, or all of a shorter template, and the words that tell its license from others.

Templates compete for a place: of spans with different labels that share half of the shorter one, the one with more
verified words stays, then the one with the greater share, so a notice that adds a condition is not taken for the one
without.  Spans are held against each other only where they stand in the same piece of a text.

The base phrases are found apart from that, at every place where their words stand one after another.

Defined results: a null text is empty; a text without hits has null first and last words, empty labels and score
0; the score is the best verified share of a template's words among spans that stay, and 1 where a base phrase stands; templates of fewer
than k words are never found; rows that repeat an id or have none get a row each; a text's words stay in its row, so
a very long text costs memory by its words; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import scratch
from folio.llm.license_texts import KEYS, TEMPLATES

K = 4
#: Diagonals at most so many words apart belong to one span.
JOIN = 4
#: Diagonals of one band at most.
WIDTH = 16
#: Share of a template's k-grams, and then of its words, that a span must hold.
COVER = 0.5
#: Words that a span of a longer template must hold at least; a shorter one must stand as a whole.
LEAST_WORDS = 12
#: Words of a piece of a text in which spans are held against each other.
PIECE = 256

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def template_table(spark: SparkSession, templates: dict[str, list[str]] | DataFrame = TEMPLATES) -> DataFrame:
    """(label, template, said, keys): the words of each template, and those of them that its spans must hold.

    Templates come by label, with the keys of ``KEYS``, or as a table (label, template, text), where a column ``keys``
    may name such words.
    """
    if isinstance(templates, dict):
        rows = [(label, n, text, list(KEYS.get(label, ()))) for label, texts in templates.items() for n, text in enumerate(texts)]
        table = spark.createDataFrame(rows, "label string, template int, text string, keys array<string>")
    else:
        table = templates if "keys" in templates.columns else templates.withColumn("keys", F.array().cast("array<string>"))
    said = table.select("label", "template", word_array(F.col("text")).alias("said"), F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
    said = said.withColumn("keys", F.array_intersect("keys", "said"))
    return F.broadcast(said) if isinstance(templates, dict) else scratch.limited(scratch.stored(said, "license-templates"))


def k_grams(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, by their first."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def spans(rows: DataFrame, *, k: int = K, join: int = JOIN, width: int = WIDTH, cover: float = COVER, templates: dict[str, list[str]] | DataFrame = TEMPLATES) -> DataFrame:
    """(row, label, score) of verified spans, from (row, text)."""
    said = template_table(rows.sparkSession, templates)
    grams = said.select("label", "template", (F.size("said") - k + 1).alias("grams"), F.posexplode(k_grams(F.col("said"), k)).alias("q", "h"))
    grams = F.broadcast(grams) if isinstance(templates, dict) else scratch.limited(scratch.stored(grams, "license-grams"))
    hashed = rows.select("row", word_array(F.col("text")).alias("words")).select("row", F.posexplode(k_grams(F.col("words"), k)).alias("p", "h"))
    hits = hashed.join(grams, "h")
    diagonals = hits.groupBy("row", "label", "template", "grams", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("qs"))
    near = Window.partitionBy("row", "label", "template").orderBy("d")
    islands = diagonals.withColumn("new", (F.col("d") - F.lag("d").over(near) > join).cast("int")).withColumn("island", F.sum(F.coalesce("new", F.lit(0))).over(near))
    off = F.col("off")
    islands = islands.withColumn("off", F.col("d") - F.min("d").over(Window.partitionBy("row", "label", "template", "island")))
    laid = islands.withColumn("band", F.explode(F.array(2 * F.floor(off / width), 2 * F.floor((off + width // 2) / width) + 1)))
    bands = laid.groupBy("row", "label", "template", "grams", "island", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("votes"), F.min("d").alias("low"), F.max("d").alias("high")
    )
    likely = scratch.stored(bands.filter(F.col("votes") >= cover * F.col("grams")).select("row", "label", "template", "low", "high"), "license-bands")
    # the words of texts with a likely band, and of these only, are compared with the template's
    texts = rows.join(scratch.limited(scratch.stored(likely.select("row").distinct(), "license-rows")), "row").select("row", word_array(F.col("text")).alias("words"))
    # of a text only the words that a band can meet go on with it, so that many notices in one text cost its words once
    begin = F.greatest("low", F.lit(0))
    found = likely.join(said, ["label", "template"]).join(texts, "row").select("row", "label", "low", "high", "keys", "said", begin.alias("begin"), F.slice("words", begin + 1, F.greatest(F.col("high") + F.size("said") - begin, F.lit(0))).alias("near"))
    matched = F.filter(F.sequence(F.lit(0), F.size("said") - 1), lambda q: F.exists(F.sequence("low", "high"), lambda d: (q + d >= F.col("begin")) & F.get("near", q + d - F.col("begin")).eqNullSafe(F.get("said", q))))
    verified = found.select("row", "label", "low", "high", "keys", "said", matched.alias("at")).filter(F.size("at") > 0)
    told = F.forall("keys", lambda w: F.exists("at", lambda q: F.get("said", q) == w))
    enough = (F.col("score") >= cover) & (F.col("matched") >= F.least(F.lit(LEAST_WORDS), F.col("size"))) & F.col("told")
    verified = verified.select("row", "label", F.size("at").alias("matched"), (F.size("at") / F.size("said")).alias("score"), F.size("said").alias("size"), (F.col("low") + F.array_min("at")).alias("start"), (F.col("high") + F.array_max("at") + 1).alias("end"), told.alias("told"))
    verified = scratch.stored(verified.filter(enough).select("row", "label", "start", "end", "matched", "score").distinct(), "license-spans")
    return verified.join(_beaten(verified), ["row", "label", "start", "end", "matched", "score"], "left_anti").select("row", "label", "score")


def _beaten(found: DataFrame) -> DataFrame:
    """The spans that a better one of another label stands over.  Spans meet in the pieces of a text that they touch."""
    pieces = F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor((F.col("end") - 1) / PIECE)))
    mine = found.withColumn("piece", pieces)
    theirs = mine.select("row", "piece", F.col("label").alias("b_label"), F.struct("matched", "score", "label").alias("b_rank"), F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct()
    met = mine.join(theirs, ["row", "piece"]).filter((F.col("label") != F.col("b_label")) & (F.col("b_rank") > F.struct("matched", "score", "label")))
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    over = 2 * shared >= F.least(F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start"))
    return met.filter(over).select("row", "label", "start", "end", "matched", "score").distinct()


def phrase_starts(words: Column, phrase: str) -> Column:
    """Numbers of the words at which a phrase stands; only texts with all its words are gone through."""
    said = phrase.split()
    there, starts = F.lit(True), F.sequence(F.lit(0), F.size(words) - len(said))
    for w in said:
        there = there & F.array_contains(words, w)
    for j, w in enumerate(said):
        starts = F.filter(starts, lambda i: F.get(words, i + j) == w)  # noqa: B023
    return F.when((F.size(words) >= len(said)) & there, starts).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, join: int = JOIN, width: int = WIDTH, cover: float = COVER, templates: dict[str, list[str]] | DataFrame = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), scratch.row_digest(id_col, text_col).alias("row"))
    words = rows.select("id", "row", word_array(F.col("text")).alias("words"))
    places = {label: phrase_starts(F.col("words"), phrase) for phrase, label in PHRASES.items()}
    based = words.select("id", "row", F.size("words").cast("long").alias("n_words"), *(x.alias(f"at_{i}") for i, x in enumerate(places.values())))
    at = [F.col(f"at_{i}") for i in range(len(places))]
    based = based.select(
        "id", "row", "n_words",
        F.array_sort(F.concat(*at)).alias("places"),
        F.array_compact(F.array(*(F.when(F.size(a) > 0, label) for a, label in zip(at, places, strict=True)))).alias("base"),
    )
    found = spans(rows.select("row", "text"), k=k, join=join, width=width, cover=cover, templates=templates)
    found = found.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    joined = based.join(found, "row", "left")
    base = F.col("base")
    return joined.select(
        F.col("id").alias(id_col), "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0)).cast("long").alias("first_word"),
        F.get("places", F.size("places") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(scratch.documents(spark, sf_dir))
