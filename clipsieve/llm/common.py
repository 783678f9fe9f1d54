"""What several operators share: tables, work folders, words and fast exact tokenisation."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipsieve.session import shared_dir

#: Fixed value: a word is a run of anything but the space and the control characters TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWER_TABLE = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the storage that the driver and all executors share."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in shared storage, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser: unsigned integers in, evenly spread unsigned integers out."""
    x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(source: Iterator[pa.RecordBatch], text: str, budget: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``budget`` bytes of text, and of one row at least."""
    for batch in source:
        if not batch.num_rows:
            continue
        sizes = batch.column(text)
        sizes = np.asarray(pc.fill_null(pc.binary_length(sizes), 0))
        at = np.cumsum(sizes, dtype=np.int64) // budget
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def default_tokenizer() -> str:
    """Place of the byte-level BPE vocabulary; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Texts that are encoded as they are: white space in a row or other than space and line feed,
#: and the cut mark itself.
_ODD_SPACE = r"[ \n]{2}|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Commas and full stops before which a text can't be cut: those not after a Latin letter or digit.
_ODD_POINT = r"(?:^|[^0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}])[.,]"
#: Pieces that may be encoded in one text, a line feed between them, and how many are; those of Latin letters are one word of any
#: byte-level vocabulary, so they needn't be split by its pattern.
_PLAIN = re.compile(r" ?\S+").fullmatch
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+").fullmatch
_JOINED = 1000
#: The character that stands for each byte in a byte-level vocabulary, and that of the line feed.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = np.arange(256, dtype="<u2")
_BYTES[np.setdiff1d(_BYTES, _SHOWN)] = np.arange(256, 512 - len(_SHOWN))
_FEED = chr(_BYTES[10])


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A byte-level BPE vocabulary never joins characters over certain places: before a single space,
    around a single line feed, between a letter and a comma or full stop.  Texts are cut there, and
    each distinct piece is encoded once, many new ones in one text, and remembered.  Texts in which such places can't be told
    (white space in a row, tabs) are encoded as they are, and so are all where the file names another way to
    split text first.  Strings of special tokens inside a text are ordinary text.  ``memory`` bounds the remembered pieces.
    """

    def __init__(self, path: str, memory: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.memory = memory
        before = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        self.cuts = self.tokenizer.normalizer is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.cuts else []
        self.feed = feed[0] if len(feed) == 1 else None
        self.by_pattern, self.at_feeds = self.tokenizer.pre_tokenizer, Split(_FEED, "isolated")
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keeps a quarter: the pieces learnt first, which are the common ones."""
        self.known = dict(islice(self.known.items(), self.memory // 4))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain pieces in a row, and each piece's number of ids; the line feeds between them tell them apart."""
        joined = ["\n".join(pieces[k : k + _JOINED]) + "\n" for k in range(0, len(pieces), _JOINED)]
        if words:
            self.tokenizer.pre_tokenizer = self.at_feeds
            ids = self._encode([_BYTES[np.frombuffer(t.encode(), np.uint8)].tobytes().decode("utf-16-le") for t in joined])
            self.tokenizer.pre_tokenizer = self.by_pattern
        else:
            ids = self._encode(joined)
        flat = np.concatenate(ids)
        feeds = np.flatnonzero(flat == self.feed)
        if feeds.size == len(pieces):
            return np.delete(flat, feeds), np.diff(feeds, prepend=-1) - 1
        return self._encode_each(pieces)  # the vocabulary has other uses for the line feed

    def _encode_each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._encode(pieces)
        return np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, pieces: list[str]) -> None:
        words, plain, rest = [], [], []
        for p in pieces:
            (rest if self.feed is None else words if _WORD(p) else plain if _PLAIN(p) else rest).append(p)
        if words:
            self._remember(words, *self._encode_pieces(words, True))
        if plain:
            self._remember(plain, *self._encode_pieces(plain, False))
        if rest:
            self._remember(rest, *self._encode_each(rest))

    def _remember(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, used = len(self.known), int(self.starts[len(self.known)])
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.starts = self._longer(self.starts, len(self.known) + 1)
        self.starts[first + 1 : len(self.known) + 1] = used + np.cumsum(lengths)
        self.flat = self._longer(self.flat, used + flat.size)
        self.flat[used : used + flat.size] = flat

    @staticmethod
    def _longer(x: np.ndarray, least: int) -> np.ndarray:
        return x if x.size >= least else np.concatenate([x, np.zeros(max(least, 2 * x.size) - x.size, x.dtype)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The number of every piece, in order, the distinct pieces, and each text's number of pieces."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.cuts:
            pieces = texts.dictionary_encode()
            return np.asarray(pieces.indices), _strings(pieces.dictionary), np.ones(len(texts), np.int64)
        odd_space, odd_point = (pc.match_substring_regex(texts, p) for p in (_ODD_SPACE, _ODD_POINT))
        marked = pc.if_else(odd_space, "", texts)
        for mark, cut in (("\n", "\x00\n\x00"), (" ", "\x00 ")):
            marked = pc.replace_substring(marked, mark, cut)
        points = pc.replace_substring(pc.replace_substring(marked, ",", "\x00,"), ".", "\x00.")
        cut = pc.split_pattern(pc.if_else(odd_point, marked, points), "\x00")
        counts = np.asarray(pc.list_value_length(cut)).astype(np.int64)
        pieces = cut.flatten().dictionary_encode()
        at, distinct = np.array(pieces.indices), _strings(pieces.dictionary)
        if (whole := np.flatnonzero(odd_space)).size:  # one empty piece each so far
            at[(np.cumsum(counts) - counts)[whole]] = np.arange(len(distinct), len(distinct) + whole.size)
            distinct += _strings(texts.take(pa.array(whole)))
        return at, distinct, counts

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of ids; ``end`` is put after every text; null is empty."""
        if len(self.known) > self.memory:
            self._forget()
        which, pieces, counts = self._cut(texts)
        if missing := [p for p in pieces if p not in self.known]:
            self._learn(list(dict.fromkeys(missing)))
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[which]
        starts = self.starts[at]
        lengths = self.starts[at + 1] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        sizes = total[bounds[1:]] - total[bounds[:-1]]
        if end is not None:
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end))
            sizes = sizes + 1
        return ids.astype("<u4"), sizes


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; what it remembers serves the worker's next tasks."""
    return Encoder(path)


def sampled_rows(docs: DataFrame, marks: DataFrame | None, most: int) -> DataFrame:
    """At most ``most`` distinct rows ``doc_id, text`` of ``docs``, with the columns of ``marks`` and the row's hash ``h``.

    Taken in the order of a hash of id and text, so the choice never depends on partitions.  ``marks`` has one row a
    doc_id; without it any row with a doc_id may be taken.  The bound holds for rows, however often a doc_id or a
    whole row is repeated; texts aren't shuffled before they are chosen.
    """
    row = F.xxhash64("doc_id", "text")
    every = docs.where("doc_id is not null").select("doc_id", row.alias("h")).distinct()
    wanted = (every if marks is None else every.join(marks, "doc_id")).orderBy("h", "doc_id").limit(most)
    found = docs.select("doc_id", "text", row.alias("h")).join(F.broadcast(wanted), ["doc_id", "h"])  # at most ``most`` rows
    return found.dropDuplicates(["doc_id", "h"])
