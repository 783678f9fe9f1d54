"""Quality by line labelling: a linear-chain conditional random field marks lines as content or boilerplate.

Each line of a whole text has the features of ``FEATURES``; Viterbi decoding finds the best sequence of labels, and a
document is kept if content lines hold ``CONTENT_SHARE`` of its word characters.  The field is trained by maximum
likelihood on ``MAX_SAMPLE`` distinct labelled rows at most, in the order of a hash of doc_id and text, and ``MAX_LINES`` lines in a
row of each, from a place the hash names, every line bearing its document's quality; a ridge on the transitions keeps single lines free to differ.

Base rules come first: fewer than 20 words, or over 30 % of the words in repeated 8-word windows, fail a document.

Defined results: a null or empty text has no words and fails; text that is all white space has one or more lines
and no word; rows that repeat a doc_id are judged each; without labels only the base rules decide; an empty table gives no row; a null doc_id is kept in the row;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clipsieve.llm.common import batches, mix64, sampled_rows
from clipsieve.llm.shingles import words

MAX_SAMPLE = 2_000
MAX_LINES = 400
CONTENT_SHARE = 0.5
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of words
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Shares of a line's characters, then yes or no.
FEATURES = ("upper", "digit", "symbol", "shout", "pipe", "link", "seen before", "under three words", "no end mark", "bias")


@dataclass
class Lines:
    """All lines of some texts."""

    per_text: np.ndarray
    features: np.ndarray
    word_chars: np.ndarray
    symbols: np.ndarray
    repeated: np.ndarray  # equal to an earlier line of the text, with a word


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars.encode())] = 1
    return table


_UPPER, _DIGIT, _SYMBOL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(SYMBOLS)
_SHOUT, _PIPE, _LINK, _END = _class("!"), _class("|"), _class("/@<>=_"), _class(".!?:;\"')")
_SPACE = _class(" \t\n\x0b\x0c\r")
_HEAD = np.array([0 if 0x80 <= b < 0xC0 else 1 for b in range(256)])  # bytes that begin a character


def lines(texts: pa.Array) -> Lines:
    """Features of the \\n-split lines of every text; a null text has one empty line."""
    listed = [t or "" for t in texts.to_pylist()]
    split = [t.split("\n") for t in listed]
    per_text = np.fromiter(map(len, split), np.int64, len(split))
    repeated: list[bool] = []
    for own in split:
        seen: set[str] = set()
        for line in own:
            repeated.append(line in seen)
            seen.add(line)
    data = np.frombuffer(("\n".join(listed) + "\n").encode(), np.uint8)
    stops = np.flatnonzero(data == 10)
    starts = np.append(0, stops[:-1] + 1)
    total = lambda table: np.add.reduceat(table[data], starts)
    space = _SPACE[data]
    word_chars = np.add.reduceat(_HEAD[data] * (1 - space), starts)
    begins = (1 - space) * np.append(1, space[:-1])
    n_words = np.add.reduceat(begins, starts)
    size = np.maximum(word_chars, 1)
    symbols = total(_SYMBOL)
    last = data[np.maximum(stops - 1, 0)]
    again = np.array(repeated, bool) & (word_chars > 0)
    columns = [
        total(_UPPER) / size, total(_DIGIT) / size, symbols / size, total(_SHOUT) / size, total(_PIPE) / size, total(_LINK) / size,
        again, n_words < 3, (_END[last] == 0) | (stops == starts), np.ones(len(starts)),
    ]
    return Lines(per_text, np.stack([np.asarray(c, float) for c in columns], 1), word_chars, symbols, again)


def repeated_words(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and those of them in ``window``-word windows found twice or more in it."""
    hashes, counts = words(texts, lower=False)
    rolled = np.zeros(hashes.size, np.uint64)
    for k in range(window):
        rolled[: max(hashes.size - k, 0)] += hashes[k:] * np.uint64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
    rolled = mix64(rolled)
    out = np.zeros(len(counts), np.int64)
    start = 0
    for k, n in enumerate(counts.tolist()):
        if n > window:
            own = rolled[start : start + n - window + 1]
            ordered = np.sort(own)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if twice.size:
                at = np.flatnonzero(np.isin(own, twice))
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                out[k] = (np.cumsum(cover[:-1]) > 0).sum()
        start += n
    return counts, out


@dataclass
class Field:
    """``emission``: weight of each feature for content; ``move[a, b]``: score of label b after label a (1 is content)."""

    emission: np.ndarray
    move: np.ndarray

    def viterbi(self, features: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The label of every line."""
        score = features @ self.emission
        order = np.argsort(-per_text, kind="stable")
        first = (np.cumsum(per_text) - per_text)[order]
        left = per_text[order]
        back = np.zeros((score.size, 2), np.int8)
        best = np.zeros((order.size, 2))
        best[:, 1] = score[first]
        longest = int(left[0]) if left.size else 0
        for t in range(1, longest):
            n = int(np.searchsorted(-left, -t, "left"))
            come = best[:n, :, None] + self.move[None]
            at = first[:n] + t
            back[at] = come.argmax(1)
            best[:n] = come.max(1)
            best[:n, 1] += score[at]
        label = np.zeros(score.size, np.int8)
        now = best.argmax(1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            n = int(np.searchsorted(-left, -t, "left"))
            at = first[:n] + t
            label[at] = now[:n]
            now[:n] = back[at, now[:n]]
        return label


def fit(features: np.ndarray, per_text: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.2, ridge: float = 1e-3, ridge_move: float = 0.2) -> Field:
    """Maximum likelihood with forward and backward sums; texts are weighed alike, whatever their number of lines."""
    n_features = features.shape[1]
    w, move = np.zeros(n_features), np.zeros((2, 2))
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    left, y = per_text[order], labels[order].astype(np.int64)
    weight = 1 / np.repeat(per_text, per_text)
    longest, n_texts = int(left[0]), left.size
    alive = [int(np.searchsorted(-left, -t, "left")) for t in range(longest)]
    line_label = np.repeat(labels, per_text).astype(float)
    m1, m2 = np.zeros(n_features + 4), np.zeros(n_features + 4)
    for step in range(1, steps + 1):
        score = features @ w
        ahead, behind = np.zeros((score.size, 2)), np.zeros((score.size, 2))
        ahead[first, 1] = score[first]
        for t in range(1, longest):
            at = first[: alive[t]] + t
            x = ahead[at - 1][:, :, None] + move[None]
            ahead[at] = np.logaddexp(x[:, 0], x[:, 1])
            ahead[at, 1] += score[at]
        pairs = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            at = first[: alive[t]] + t
            after = behind[at].copy()
            after[:, 1] += score[at]
            x = move[None] + after[:, None, :]
            behind[at - 1] = np.logaddexp(x[:, :, 0], x[:, :, 1])
            joint = ahead[at - 1][:, :, None] + x
            joint = np.exp(joint - joint.max((1, 2), keepdims=True))
            pairs += ((joint / joint.sum((1, 2), keepdims=True)) * weight[at][:, None, None]).sum(0)
        both = ahead + behind
        content = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
        want = np.zeros((2, 2))
        for label in (0, 1):
            own = y == label
            want[label, label] = ((left[own] - 1) / left[own]).sum()
        grad = np.concatenate([features.T @ ((content - line_label) * weight) / n_texts + ridge * w, ((pairs - want) / n_texts + ridge_move * move).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        change = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w -= change[:n_features]
        move -= change[n_features:].reshape(2, 2)
    return Field(w, move)


def train(docs: DataFrame, labels: DataFrame, max_sample: int = MAX_SAMPLE, max_lines: int = MAX_LINES) -> Field | None:
    """Fits in one task to the line features of a bounded sample of labelled rows; None without both kinds of label."""
    usable = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    width = len(FEATURES)

    def run(source):
        for batch in batches(source, "text"):
            x = lines(batch.column("text"))
            ends = np.cumsum(x.per_text)
            parts = []
            for a, b, h in zip((ends - x.per_text).tolist(), ends.tolist(), batch.column("h").to_pylist()):
                a += h % (b - a - max_lines + 1) if b - a > max_lines else 0
                parts.append(x.features[a : min(a + max_lines, b)].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(parts, pa.binary())], names=["quality", "features"])

    def learn(source):
        found = sorted((q, f) for batch in source for q, f in zip(batch.column("quality").to_pylist(), batch.column("features").to_pylist()))
        if len({q for q, _ in found}) < 2:
            return
        parts = [np.frombuffer(x, "<f4").reshape(-1, width).astype(float) for _, x in found]
        field = fit(np.concatenate(parts), np.array([len(p) for p in parts]), np.array([q for q, _ in found]))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (field.emission, field.move)], names=["emission", "move"])

    rows = sampled_rows(docs, usable, max_sample).select("quality", "text", "h")
    parts = rows.mapInArrow(run, "quality int, features binary").repartition(1)
    found = parts.mapInArrow(learn, "emission binary, move binary").first()
    return found and Field(np.frombuffer(bytes(found["emission"])), np.frombuffer(bytes(found["move"])).reshape(2, 2))


def judge(docs: DataFrame, field: Field | None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The base counts, verdicts, and the number of content lines and their share of word characters, for every row."""

    def run(source):
        for batch in batches(source, "text"):
            text = batch.column("text")
            x = lines(text)
            n_words, n_repeat = repeated_words(text)
            first = np.cumsum(x.per_text) - x.per_text
            total = lambda v: np.add.reduceat(v, first)
            label = np.ones(x.word_chars.size, np.int64) if field is None else field.viterbi(x.features, x.per_text).astype(np.int64)
            chars = total(x.word_chars)
            share = total(x.word_chars * label) / np.maximum(chars, 1)
            failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(chars), pa.array(total(x.symbols)), pa.array(total(x.repeated.astype(np.int64))),
                pa.array(n_repeat), pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(total(label)), pa.array(share),
            ], names=[c.split()[0] for c in _JUDGED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _JUDGED)


_JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "content_lines long, content_share double"
)
