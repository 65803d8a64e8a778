"""Token counts behind a digest cache: only texts whose digest is not stored yet are encoded.

The cache is a Parquet table (content digest, tokenizer version, tokens).  The content digest is SHA-256 of the
text without leading and trailing blanks, which the tokenizer drops; the version is the SHA-256 of the vocabulary
file with the settings used.  One call joins the texts' digests with the cache and makes a bitmap of the hashes of
those that are missing.  The second scan of the texts lets through only rows whose hash is in the bitmap, before
anything is shuffled: one text of each digest is taken from them, chosen by the digest itself and never by an id, those
of missing digests are encoded, their counts are appended, and the counts are joined back by digest.  If nothing is
missing there is no second scan.  A task that is run again only repeats its own encoding, and the table is appended by
Spark's committer; counts that two writers store for one digest are equal, and readers take any one of them.

Inside a task a text is cut at blanks and newlines, where this tokenizer always cuts too, and each distinct piece
is encoded once by the library, as long as it is in the bounded table of known pieces.  This holds for
tokenizers that drop white space; another vocabulary needs its own counter.

Defined results: a null text counts as empty with 0 tokens; special strings inside a text are handled as the
library's default, which matches their letter case too; rows with the same id or none are counted one by one; a very
long text is encoded whole, its distinct pieces once; an empty table gives an empty one and adds nothing to the cache;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import scratch

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces that a task remembers at most; beyond that it forgets them all and goes on.
KNOWN_PIECES = 600_000
#: Bits of the bitmap of missing digests, which is broadcast: 16 MB at most, whatever the number of digests.
BITS = 1 << 27
CACHE_SCHEMA = "digest string, version string, n_tokens long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes() + b"|no added special tokens|no truncation|special strings by case").hexdigest()


#: Punctuation that this tokenizer always parts from a letter or digit before it.
_TRAILING = ".,;:!?%*#$&|)"
_PLAIN = re.compile("[a-z]+").fullmatch
_LETTER_OR_DIGIT = re.compile("[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]").fullmatch


class Counter:
    """Counts tokens of texts with the library, which sees each distinct word once.

    A piece between blanks is looked up as it is.  A new one is lower-cased over A-Z, parted from punctuation
    at its end where a letter or digit stands before it, and the two parts are looked up and encoded if new.
    One that would hold a special string in lower case stays whole and as it is.
    """

    def __init__(self, path: str, limit: int = KNOWN_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.known: dict[str, int] = {"": 0}
        self.parts: dict[str, int] = {"": 0}

    def _parts(self, piece: str) -> tuple[str, str]:
        low = piece.lower() if piece.isascii() else piece
        if any(x in low for x in self.special):
            return piece, ""
        core = low.rstrip(_TRAILING)
        return (core, low[len(core) :]) if core and len(core) < len(low) and _LETTER_OR_DIGIT(core[-1]) else (low, "")

    def _learn(self, pieces: set[str]) -> None:
        split = {p: self._parts(p) for p in pieces}
        tokenize = self.tokenizer.model.tokenize
        new = {x for pair in split.values() for x in pair} - self.parts.keys()
        plain = [x for x in new if _PLAIN(x)]
        self.parts.update((x, len(tokenize(x))) for x in plain)
        rest = list(new.difference(plain))
        for i in range(0, len(rest), 50_000):
            some = rest[i : i + 50_000]
            self.parts.update(zip(some, map(len, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        self.known.update((p, self.parts[a] + self.parts[b]) for p, (a, b) in split.items())

    def count(self, texts: list[str]) -> list[int]:
        pieces = [x.replace("\n", " ").split(" ") for x in texts]
        new = {p for own in pieces for p in own} - self.known.keys()
        if len(self.known) + len(new) > self.limit:
            self.known, self.parts = {"": 0}, {"": 0}
            new = {p for own in pieces for p in own}
        self._learn(new)
        return [sum(map(self.known.__getitem__, own)) for own in pieces]


#: One counter for each vocabulary in a worker process, kept from task to task.
_counters: dict[str, Counter] = {}


def _encode(path: str, version: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(path) or _counters.setdefault(path, Counter(path))
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1).fill_null("")
            at = 0
            while at < len(texts):
                some, size = [], 0
                while at + len(some) < len(texts) and size < 1 << 20:
                    some.append(texts[at + len(some)].as_py())
                    size += len(some[-1])
                yield pa.RecordBatch.from_pydict({"digest": digests.slice(at, len(some)), "version": pa.array([version] * len(some)), "n_tokens": pa.array(counter.count(some), pa.int64())})
                at += len(some)

    return encode


def content_digest(text):
    return F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """What the cache holds for a tokenizer version; an empty table if there is no cache yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def _bit(digest: str):
    return F.pmod(F.xxhash64(digest), F.lit(BITS))


def only_missing(texts: DataFrame, missing: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose digest may be in ``missing``: all that are, and few others, by a broadcast bitmap."""
    bit = missing.select(_bit("digest").alias("bit"))
    bitmap = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    position = F.bitmap_bit_position(_bit("digest"))
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    let = texts.withColumn("bucket", F.bitmap_bucket_number(_bit("digest"))).join(F.broadcast(bitmap), "bucket")
    return let.filter(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) != 0).select(*texts.columns)


def count_tokens(docs: DataFrame, cache: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, digest, n_bytes, n_tokens) for each row; appends the counts of new texts to ``cache``.

    Only digests and counts meet in the joins of rows, and only texts of missing digests are dealt out.  A text is
    chosen for each digest by grouping on the digest alone, and each task combines its own copies before they are dealt
    out, so a group of copies, however large, sends narrow rows and one text for each task at most.  Counts are read
    again before they meet the rows, so that the rows of a very common text can be split.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or vocabulary_path()
    version = tokenizer_version(vocabulary)
    digest = content_digest(F.col(text_col))
    narrow = scratch.stored(docs.select(F.col(id_col), digest.alias("digest"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")), "token-digests")
    told = scratch.stored(narrow.select("digest").distinct().join(cached(spark, cache, version), "digest", "left"), "token-told")
    missing = told.filter("n_tokens is null").select("digest")
    known = told.filter("n_tokens is not null")
    if not missing.isEmpty():
        texts = docs.select(digest.alias("digest"), F.col(text_col).alias("text"))
        if not known.isEmpty():
            texts = only_missing(texts, missing)
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        misses = texts.join(missing.hint("shuffle_hash"), "digest").select("digest", "text")
        misses.mapInArrow(_encode(vocabulary, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
        found = cached(spark, cache, version).join(missing, "digest", "left_semi")
        known = known.unionByName(scratch.stored(found, "token-found"))
    return narrow.join(known, "digest").select(id_col, "digest", "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(scratch.documents(spark, sf_dir), scratch.new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
