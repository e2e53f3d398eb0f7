"""Best-fit packing of token pieces into sequences of a fixed length.

Documents are encoded by a tokenizer file, closed with an end id and, only where
longer than a sequence, cut into pieces. Pieces are then packed online with
bounded space: a packer holds at most OPEN_BINS open bins, found through a bitset
with a bit for each amount of free space; a piece goes to the bin that it leaves
the least space in, and when no bin has room and all are open, the fullest is
closed. Pieces are dealt to packers by a hash of their document, about
PACKER_PIECES pieces each, so packers grow in number, not in size, and a result
doesn't depend on how the input is split; where copies of one row would fill a
packer, they are dealt to all.

Null text is empty: one piece that holds the end id. Repeated rows are packed
each, and a row without a key like others. Pieces that tie go by key, place and
checksum; of several bins with the same free space the one put there last is taken.
An empty table gives an empty result. Columns beyond the two used are ignored.

A tokenizer file that doesn't allow words to be encoded apart is noticed while it is
read (``Encoder.check``) or used, and whole texts are encoded by the library then.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import Tables, map_arrow

LENGTH, END_ID, OPEN_BINS, PACKER_PIECES = 4096, 1, 1024, 60_000
#: Bytes of words and their ids that a worker keeps at most, and of text that it looks at together.
CACHE_BYTES, CHUNK = 16 << 20, 2 << 20

#: Marks that may end a word and are no letters, digits or apostrophes.
TAIL = ".,!?;:*%&$#|"
#: Letters of which a run is one match and which no normal form puts together.
LETTERS = "".join(c for c in map(chr, range(0x130)) if c.isalpha())
#: The tokenizer's own end mark.
MARK = "<|endoftext|>"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_key long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _taken(blob: np.ndarray, length: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of blob (length has their lengths) that codes names, one after another, and their lengths."""
    n = length[codes]
    shift = (np.cumsum(length) - length)[codes] - (np.cumsum(n) - n)
    return blob[np.repeat(shift, n) + np.arange(n.sum())], n


class Encoder:
    """Ids of texts as little-endian bytes. Words between blanks and line ends are encoded apart, which this tokenizer allows: it drops white space and no match crosses it.

    A run of plain letters is one match and the marks after it are another, so words are taken as such parts. What a worker
    knows of parts are three arrays: the parts, how many ids each has, and these ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.is_end = ends
        self.mark = self.tokenizer.token_to_id(MARK)
        self._forget()
        self.plain = not self.check()

    def _forget(self) -> None:
        self.parts, self.length, self.blob = pa.array([""], pa.string()), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def check(self) -> bool:
        """Whether this file's tokenizer drops white space, ends words and keeps its end mark apart."""
        if self.mark is None or not self.is_end.any():
            return False
        try:
            return self._ids("a b  word.\nWord 12").tobytes() == self._encode_apart(["a b  word.\nWord 12"])[0]
        except ValueError:
            return False
        finally:
            self._forget()

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and the ids. Runs of letters go through the library as one text of blanks between
        and end where a token ends a word; others are put between end marks, or go alone where they may hold one."""
        letters = np.asarray(pc.equal(pc.utf8_ltrim(parts, LETTERS), ""))
        length, own = np.zeros(len(parts), np.int64), []
        order = [np.flatnonzero(letters), np.flatnonzero(~letters)]
        for kind, rows in enumerate(order):
            words = parts.take(pa.array(rows)).to_pylist()
            for at in range(0, len(words), 4000):
                some, here = words[at : at + 4000], rows[at : at + 4000]
                if kind == 0:
                    ids = self._ids(" ".join(some))
                    ends = np.flatnonzero(self.is_end[ids]) + 1
                    if len(ends) != len(some):
                        raise ValueError("the tokenizer file doesn't mark the ends of words")
                    length[here] = np.diff(ends, prepend=0)
                elif any("<|" in w for w in some):
                    each = [self._ids(w) for w in some]
                    length[here], ids = list(map(len, each)), np.concatenate(each)
                else:
                    ids = self._ids(MARK.join(some) + MARK)
                    ends = np.flatnonzero(ids == self.mark)
                    if len(ends) != len(some):
                        raise ValueError("the tokenizer file doesn't keep its end mark apart")
                    length[here], ids = np.diff(ends, prepend=-1) - 1, ids[ids != self.mark]
                own.append(ids)
        order = np.concatenate(order)
        blob, _ = _taken(np.concatenate(own), length[order], np.argsort(order))
        return length, blob

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if not self.plain:
            try:
                return self._encode_apart(texts)
            except ValueError:
                self.plain = True
                self._forget()
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_apart(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        rows = pc.split_pattern(pa.array([self.lower(t).replace("\n", " ") for t in texts], pa.string()), " ")
        words = rows.values.dictionary_encode()
        distinct = words.dictionary
        core = pc.utf8_rtrim(distinct, TAIL)
        split = pc.and_(pc.not_equal(core, ""), pc.equal(pc.utf8_ltrim(core, LETTERS), ""))
        parts = pa.concat_arrays([pc.if_else(split, core, distinct), pc.if_else(split, pc.utf8_ltrim(distinct, LETTERS), "")]).dictionary_encode()
        at = self._places(parts.dictionary)
        blob, n = _taken(self.blob, self.length, at[np.asarray(parts.indices)].reshape(2, -1).T.ravel())
        blob, n = _taken(blob, n.reshape(-1, 2).sum(1), np.asarray(words.indices))
        self._keep(at)
        ends = np.append(0, np.cumsum(n))[np.asarray(rows.offsets)].tolist()
        return [blob[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Where parts (each once) are among those known; new ones are encoded and known from then on."""
        at = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(pc.is_null(at))
        at = np.asarray(at.fill_null(-1)).astype(np.int64)
        if len(new):
            length, blob = self._encode_parts(new)
            at[at < 0] = np.arange(len(new)) + len(self.parts)
            self.parts, self.length, self.blob = pa.concat_arrays([self.parts, new]), np.append(self.length, length), np.append(self.blob, blob)
        return at

    def _keep(self, at: np.ndarray) -> None:
        """Where parts have become many, those at ``at`` alone are kept, and none where these are many."""
        for last in (False, True):
            if self.parts.nbytes + self.length.nbytes + self.blob.nbytes <= CACHE_BYTES:
                return
            if last:
                return self._forget()
            self.blob, self.length = _taken(self.blob, self.length, at)
            self.parts = self.parts.take(pa.array(at))

    @staticmethod
    def lower(text: str) -> str:
        """text in lower case where every way to do that agrees (Latin-1); the tokenizer does it anyway, but fewer words are to be known so."""
        if "<|" in text:  # a special token's name in capitals is ordinary text
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()


def pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document, and a hash of its document for dealing."""

    def make():
        encoder, end = Encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()

        def step(part):
            got = encoder.encode_all([t or "" for t in part.column("_text").to_pylist()])
            rows = []
            for doc, ids, h in zip(part.column("doc_id").to_pylist(), got, part.column("row_key").to_pylist(), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own), h))
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "row_key"), zip(*rows), strict=True))

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return map_arrow(rows.withColumn("row_key", F.xxhash64("doc_id", "_text")), make, PIECES, most_bytes=CHUNK)


class Packer:
    """Online best-fit with at most ``most`` open bins of ``length``."""

    def __init__(self, length: int = LENGTH, most: int = OPEN_BINS):
        self.length, self.most = length, most
        self.bits = 0  # bit f is set when an open bin has f free
        self.open: dict[int, list[int]] = {}
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.open[free]
        out = bins.pop()
        if not bins:
            del self.open[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return out

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the place in it of a piece."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.length, self.n_bins
            self.n_bins += 1
            if size < self.length and self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = free - size
        if left:
            self.open.setdefault(left, []).append(at)
            self.bits |= 1 << left
            self.n_open += 1
        return at, self.length - free


def pack(cut: DataFrame, length: int = LENGTH, packer_pieces: int = PACKER_PIECES, most: int = OPEN_BINS) -> DataFrame:
    """sequence_id and offset for each piece of ``pieces``; sequence ids are unique over all packers."""
    packers = max(1, -(-cut.count() // packer_pieces))

    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(key, table):
        order = pc.sort_indices(table, [(c, "ascending") for c in ("row_key", "doc_id", "start", "ids_crc32", "length")])
        table = table.take(order)
        packer, base = Packer(length, most), int(key[0].as_py()) << 40
        put = [packer.put(n) for n in table["length"].to_pylist()]
        table = table.append_column("sequence_id", pa.array([base + b for b, _ in put], pa.int64())).append_column("offset", pa.array([o for _, o in put], pa.int64()))
        return table.select(names)

    # copies of one row that would fill a packer by themselves are dealt by their place in the stored table, which a file that
    # is read again has again; there are at most as many such rows as packers
    hot = cut.groupBy("row_key", "start").agg(F.count("*").alias("n")).filter(F.col("n") > packer_pieces).select("row_key", "start", F.lit(True).alias("hot"))
    deal = F.when(F.col("hot"), F.xxhash64("row_key", "start", F.monotonically_increasing_id())).otherwise(F.xxhash64("row_key", "start"))
    dealt = cut.join(F.broadcast(hot), ["row_key", "start"], "left").withColumn("packer", F.pmod(deal, F.lit(packers)))
    return dealt.groupBy("packer").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """pieces, then pack. The pieces are written to the shared folder, as counting them would encode twice."""
    return pack(Tables(docs.sparkSession).cut(pieces(docs, vocabulary)), **options)
