"""Packing token streams into fixed windows by sum-of-squares online placement.

Each task packs the documents of its own input split, so texts are never shuffled and a lost task
is simply run again. A document longer than the window is cut at the window's length; the full
pieces are sequences of their own. The rest goes to the open window whose fill level minimises the
sum over levels of the squared number of windows filled to that level (Csirik et al., "On the
sum-of-squares algorithm for bin packing"); the counts are one array with an entry for each level.

At the end of a split, or when ``max_open`` windows are open, the windows left open are drained: the fullest are filled up
with pieces cut from the emptiest, so that at most one window of a drain is padded.

Null or empty text: the end id alone. Equal rows are packed separately. A null id stays null.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: ASCII punctuation that may follow a word; a run of it is a word of its own to the pattern. No apostrophe: contractions.
MARKS = ".,;:!?\"()[]{}<>*#$%&|/\\-_+=~`@^"


class ByteBpe:
    """Texts to ids of a ``tokenizers`` file with a byte-level pre-tokenizer, as little-endian bytes; equal to encoding each whole text.

    The byte-level pattern begins a new word at a space that a non-space follows, so what lies
    between single spaces can be encoded apart, once for a batch. A piece of letters, with a line
    feed before or marks after, is split further; new words of letters are encoded together and
    told apart by the bytes that each id stands for. Texts with white space next to white space are
    encoded whole. When more than ``most`` pieces are known, the older half stays: frequent ones are met early.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        added = self.tokenizer.get_added_tokens_decoder()
        size = {i: len(t) for t, i in self.tokenizer.get_vocab().items()} | {i: len(t.content.encode()) for i, t in added.items()}
        #: Bytes of each id: a token has one character for each.
        self.sizes = np.array([size.get(i, 0) for i in range(max(size) + 1)], np.int64)
        #: Empty for a piece that has white space at an end; those are ``irregular`` too.
        self.pieces: dict[str, bytes] = {}
        self.irregular: set[str] = set()
        self.line_feed = self.whole("\n")
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[str], before: str) -> Iterator[bytes]:
        """Ids of words of letters, each after a space or a line feed, which is a piece of its own."""
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            text = before + before.join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            stops = np.cumsum(self.sizes[ids])
            raw = np.frombuffer((text + before).encode(), np.uint8)
            want = np.flatnonzero(raw == ord(before))[1:]  # ends of the words
            cuts = np.searchsorted(stops, want)
            if len(stops) and stops[-1] == want[-1] and (stops[cuts] == want).all():
                known, start = ids.tobytes(), 0
                for stop in (4 * cuts + 4).tolist():
                    yield known[start:stop]
                    start = stop
            else:
                yield from (self.whole(before + w) for w in part)

    def learn(self, missing: set[str]) -> None:
        """A key that begins with a line feed stands for a piece after it, without a space; others follow a space."""
        pieces, spaced, marked = self.pieces, [], []
        for key in missing:
            if key.isalpha():
                spaced.append(key)
                continue
            bare = key.rstrip(MARKS)
            if bare.isalpha() or (bare[:1] == "\n" and bare[1:].isalpha()):
                marked.append((key, bare, key[len(bare) :]))
                continue
            lf = key[:1] == "\n"
            if not (body := key[lf:]) or body[0].isspace() or body[-1].isspace():
                pieces[key] = b""
                self.irregular.add(key)
            else:
                pieces[key] = self.whole(key if lf else " " + key)
        bares = {bare for _, bare, _ in marked if bare not in pieces}
        lined = [bare[1:] for bare in bares if bare[0] == "\n"]
        spaced += [bare for bare in bares if bare[0] != "\n" and bare not in missing]
        pieces.update(zip(spaced, self.words(spaced, " ")))
        pieces.update(zip(["\n" + w for w in lined], self.words(lined, "\n")))
        for key, bare, mark in marked:
            if mark:
                if mark not in self.marks:
                    self.marks[mark] = self.whole(mark)
                pieces[key] = pieces[bare] + self.marks[mark]

    def __call__(self, batch: list[str]) -> Iterator[bytes]:
        if len(self.pieces) > self.most:
            self.pieces = dict(itertools.islice(self.pieces.items(), self.most // 2))
            self.irregular &= self.pieces.keys()
            self.marks = {"": b""}
        pieces, get = self.pieces, self.pieces.get
        split = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in batch]
        found = [list(map(get, parts)) for parts in split]
        self.learn({key for parts, ids in zip(split, found) if None in ids for key, x in zip(parts, ids) if x is None})
        for text, parts, ids in zip(batch, split, found):
            if self.irregular and not self.irregular.isdisjoint(parts):
                yield self.whole(text)
            else:
                if None in ids:
                    ids = [pieces[key] if x is None else x for key, x in zip(parts, ids)]
                yield b"".join(ids)[len(self.line_feed) :]


@functools.cache
def encoder(path: str) -> ByteBpe:
    """One for each worker process, so that its pieces serve the next task too."""
    return ByteBpe(path)


class SumOfSquares:
    """Open windows by fill level. A piece is (doc, start, length, crc, doc tokens)."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.n_open = 0

    def place(self, piece: tuple) -> list | None:
        """The window's pieces if this one fills it."""
        n, w = piece[2], self.window
        # What each level's choice adds to the sum of squares; level 0 stands for a new window, full ones don't count.
        change = 2 * (self.counts[n:] - self.counts[: w - n + 1]) + 2
        change[-1] -= 1
        change[self.counts[: w - n + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.counts[n] + 1 if n < w else 0
        at = int(change.argmin())
        if at + n == w and at == 0:
            return [piece]
        if at:
            found = self.open[at].pop()
            self.counts[at] -= 1
            self.n_open -= 1
        else:
            found = []
        found.append(piece)
        if at + n == w:
            return found
        self.open[at + n].append(found)
        self.counts[at + n] += 1
        self.n_open += 1
        return None

    def drain(self) -> list[list]:
        levels = sorted(k for k, v in self.open.items() for _ in v)
        return [self.open[k].pop() for k in levels]


def packer(path: str, end_id: int, window: int, max_open: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        state, rows = SumOfSquares(window), []
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36

        def close(pieces: list) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, n_doc in ((p[0], p[1], p[3], p[4]) for p in pieces):
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), n_doc, number, at))
                at += n
            number += 1

        def drain() -> None:
            """Fill the fullest windows with what the emptiest hold, cutting pieces."""
            windows = state.drain()
            state.counts[:] = 0
            state.n_open = 0
            low, spare = 0, []
            for high in range(len(windows) - 1, -1, -1):
                if high < low:
                    break
                out = windows[high] if high >= low else []
                room = window - sum(p[2] for p in out)
                while room and (spare or low < high):
                    if not spare:
                        spare, low = windows[low], low + 1
                    doc, start, n, ids, n_doc = spare.pop()
                    k = min(n, room)
                    out.append((doc, start, k, ids[: 4 * k], n_doc))
                    if k < n:
                        spare.append((doc, start + k, n - k, ids[4 * k :], n_doc))
                    room -= k
                close(out)
            if spare:
                close(spare)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            rows.clear()
            return out

        for b in small_batches(batches, most=1 << 19):
            for doc, ids in zip(b.column(0).to_pylist(), encode(texts(b))):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    full = state.place((doc, start, len(piece) // 4, piece, n))
                    if full:
                        close(full)
                if state.n_open >= max_open:
                    drain()
            if rows:
                yield flush()
        drain()
        if rows:
            yield flush()

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    end_id: int = 1,
    max_open: int = 8192,
) -> DataFrame:
    """One row for each piece: where it starts in its document, and its sequence and offset there.

    ``max_open`` bounds the memory of a task to that many windows; no document is dropped for it.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packer(tokenizer_path, end_id, window, max_open), SCHEMA)
