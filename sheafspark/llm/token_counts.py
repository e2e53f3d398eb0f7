"""Token counts through a cache that knows a text by its digest.

A count is stored under the digest of the normalised content and under the version
of the tokenizer: a digest of the vocabulary's bytes, the library and its version. A
run digests every text, asks the cache for the distinct digests, encodes one text of
each that is missing, appends the new counts, and joins the counts to the rows.

Texts move once: each task lets a digest's first text through, so a text that a third
of all rows share comes at most once from each task; these meet by digest, where the
missing ones are encoded once each. What is joined to the rows afterwards is a digest
and a number; digests of very many rows meet theirs by broadcast.

Normalising must not change a count: white space is made one blank where the
vocabulary's own first step does that, and nothing is done for others.

Null text counts as empty, which has no tokens. A text of any length is encoded whole;
byte-level vocabularies take one of more than PART_CHARS in parts cut where a blank
stands between two Latin letters, which is a boundary whatever surrounds it, and are
asked for the distinct pieces that their pattern cuts texts into, not for each text. Ties can't
come up. Repeated rows are rows, an empty table gives an empty result and leaves the
cache as it is, and columns beyond those named are not read, whatever their names. The
cache's files come through Spark's commit, so a lost executor leaves no part of a run in
it; two runs at once may both append a digest, with the same count.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.byte_bpe import boundaries
from sheafspark.llm.common import Tables, give_back, join_counted, slices

#: Characters from which on a text is encoded in parts, and of texts that are encoded together.
PART_CHARS, BATCH_CHARS = 1 << 19, 1 << 18
#: Pieces that a worker keeps at most.
CACHE_PIECES = 400_000
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
WHITE = r"[ \t\n\x0B\f\r]+"


def _settings(vocabulary: str) -> dict:
    if not vocabulary.endswith(".json"):
        return {}
    with open(vocabulary, encoding="utf-8") as f:
        whole = json.load(f)
    return {k: whole.get(k) for k in ("normalizer", "pre_tokenizer")}


def in_parts(vocabulary: str) -> bool:
    """Whether a blank between Latin letters is a boundary: byte-level, by the usual pattern, with nothing before it."""
    s = _settings(vocabulary)
    kind = s.get("pre_tokenizer") or {}
    return bool(s) and not s["normalizer"] and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")


def normalised(text: Column, vocabulary: str) -> Column:
    """text with what can't change its count made alike."""
    own = _settings(vocabulary).get("normalizer") or {}
    steps = own.get("normalizers", [own])
    white = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    text = F.coalesce(text, F.lit(""))
    return F.regexp_replace(text, WHITE, " ") if white else text


def _library(vocabulary: str) -> str:
    kind = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(vocabulary)[1])
    if kind is None:
        raise ValueError(f"no library reads {vocabulary}")
    return kind


def version(vocabulary: str) -> str:
    """A digest of all that a count depends on but the text."""
    library = _library(vocabulary)
    with open(vocabulary, "rb") as f:
        own = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{own} {library} {__import__(library).__version__} plain".encode()).hexdigest()


def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    """Counts of texts by the vocabulary's library: no begin, end or added tokens, no truncation or padding, special strings as its default has them."""
    if _library(vocabulary) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """text in parts of about ``most`` characters that are encoded as in the whole."""
    at = 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(1)
def _unassigned() -> np.ndarray:
    """Code points that this Python's Unicode tables don't know; a library with later ones may."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]] = True
    return out


class Pieces:
    """Counts of texts by a byte-level vocabulary: the pieces that its pattern cuts are found over many texts at once, and the library counts each distinct piece once, as long as it is kept. Texts with a special string or an unknown code point are left to the library whole."""

    def __init__(self, vocabulary: str):
        self.library = counter(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.cumsum([0, *map(len, texts)])
        odd = np.flatnonzero(_unassigned()[points])
        whole = sorted({*whole, *(np.searchsorted(offsets, odd, "right") - 1).tolist()})
        start = boundaries(points, offsets[:-1][np.diff(offsets) > 0])
        cuts = start.tolist()
        own = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], len(joined)], strict=True)]
        got = list(map(self.young.get, own))
        new = dict.fromkeys([own[i] for i, n in enumerate(got) if n is None])
        self._learn(new)
        if new:
            got = [new[p] if n is None else n for p, n in zip(own, got, strict=True)]
        upto = np.concatenate([[0], np.cumsum(got)])
        at = np.searchsorted(start, offsets)
        out = (upto[at[1:]] - upto[at[:-1]]).tolist()
        if whole:
            for i, n in zip(whole, self.library([texts[i] for i in whole]), strict=True):
                out[i] = n
        return out

    def _learn(self, new: dict[str, int | None]) -> None:
        """Fills in new's counts. A full young cache becomes the old one."""
        todo = []
        for p in new:
            new[p] = self.old.get(p)
            if new[p] is None:
                todo.append(p)
        for p, n in zip(todo, self.library(todo) if todo else [], strict=True):
            new[p] = n
        if len(self.young) + len(new) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        self.young.update((p, n) for p, n in new.items() if len(p) <= 64)


def count_all(count: Callable[[list[str]], list[int]], texts: list[str], parts: bool) -> list[int]:
    out, group, chars = [0] * len(texts), [], 0

    def flush() -> None:
        for (i, _), n in zip(group, count([t for _, t in group]), strict=True):
            out[i] += n
        group.clear()

    for i, t in enumerate(texts):
        for p in pieces(t) if parts else (t,):
            if group and chars + len(p) > BATCH_CHARS:
                flush()
                chars = 0
            group.append((i, p))
            chars += len(p)
    if group:
        flush()
    return out


class Cache:
    """Counts by version and digest, as Parquet files in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, version: str) -> str:
        return f"{self.path}/{version}"

    def counts(self, version: str) -> DataFrame:
        """digest and n_tokens, a row for each digest that is stored."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(version))
        schema = "digest binary, n_tokens long"
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._at(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, version: str, counts: DataFrame) -> None:
        counts.select("digest", "n_tokens").write.mode("append").parquet(self._at(version))


def _unseen(part: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
    """part's rows whose digest is not in seen, the first of each; seen gets them."""
    keep = []
    for i, d in enumerate(part.column("digest").to_pylist()):
        if d not in seen:
            seen.add(d)
            keep.append(i)
    return part if len(keep) == part.num_rows else part.take(pa.array(keep, pa.int64()))


def once_a_task(texts: DataFrame) -> DataFrame:
    """digest and text, the first of each digest in a task; a task remembers 32 bytes a row of its own."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                yield _unseen(part, seen)
        give_back()

    return texts.mapInArrow(run, texts.schema)


def encoded(texts: DataFrame, vocabulary: str) -> DataFrame:
    """digest and n_tokens of texts, each digest's first text in a task being encoded."""
    parts = in_parts(vocabulary)

    def run(batches):
        seen: set[bytes] = set()
        count = Pieces(vocabulary) if parts else counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                part = _unseen(part, seen)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(count_all(count, part.column("text").to_pylist(), parts), pa.int64())], names=["digest", "n_tokens"])
        give_back()

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def missing(rows: DataFrame, cache: Cache, version: str) -> DataFrame:
    """The distinct digests of rows that the cache doesn't have."""
    return rows.select("digest").distinct().join(cache.counts(version), "digest", "left_anti")


def count_tokens(docs: DataFrame, vocabulary: str, cache: Cache, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """keep, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row of docs; what the cache lacked it has afterwards."""
    name, tables = version(vocabulary), Tables(cache.spark)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(normalised(F.col(text), vocabulary), "UTF-8"), 256)).alias("digest")
    rows = tables.cut(docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.octet_length(content).cast("long").alias("n_bytes"), digest))
    texts = once_a_task(docs.select(digest, content.alias("text")))
    # both sides are dealt by digest, whatever their sizes: a digest's texts meet in one task
    asked = texts.join(missing(rows, cache, name).hint("shuffle_hash"), "digest", "left_semi")
    new = encoded(asked, vocabulary)
    cache.append(name, new.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    found = rows.groupBy("digest").agg(F.count("*").alias("rows")).join(cache.counts(name), "digest")
    out = join_counted(rows, found, "digest", "rows")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
