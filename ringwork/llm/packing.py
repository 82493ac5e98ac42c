"""Packing of token ids into sequences of bounded length by multiway Karmarkar-Karp differencing.

A document's ids are cut into full sequences and a rest of short pieces. Rests gather until they fill about WINDOWS sequences; then they are
divided: each piece starts as a partial partition of its own, and the two with the largest spread are merged again and again, the fullest part of one
with the emptiest of the other. The sums come out nearly equal; if one is over the capacity, the division is made anew with one window more.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from ringwork.llm.bpe import LETTERS, MARKS, ODD_SPACE, marks_close, tokenizer
from ringwork.llm.held import Held

WINDOWS = 96  # windows divided together
REST = 256  # longest piece of a document's rest
UNIT = re.compile(r"\s+(?!\S)| ?\S+|\s")
CODES = np.array([10 if b == 10 else ord(LETTERS[b]) for b in range(256)], "<u2")  # each byte's letter; line ends stay, between words
BARE = "\x01"  # before a unit that no space stands before
UNEVEN = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)))  # space that is not single
END_ID = 0
TABLE = 48 << 20  # bytes of a table of units


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer whose pieces take at most one space before a word.

    Such pieces never join two words, so each word with its space is encoded by itself and looked up when it comes again.
    Texts with special tokens or control characters that count as space only here go to the library as they are.
    """

    def __init__(self, path: str, limit: int = TABLE):
        self.tok, self.held = tokenizer(path), Held(limit)
        self.odd = [*ODD_SPACE, BARE, *(t.content for t in self.tok.get_added_tokens_decoder().values())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def units_of(self, text: str | None, odd: list[str], uneven: list[str]) -> str | list[str] | None:
        """The units of a text: words that a space stands before, and after BARE what none stands before; None if it can't be cut so.

        They are one string with a space between each two, or a list if units hold spaces. Marks are set apart where a letter or digit stands before them and
        space behind: pieces end there. odd, uneven: those of self.odd and UNEVEN that any text of the call holds.
        """
        if not text or odd and any(x in text for x in odd):
            return None
        if text[0] in " \n" or text[-1] in " \n" or uneven and any(x in text for x in uneven):
            return [u[1:] if u[0] == " " and len(u) > 1 else BARE + u for u in UNIT.findall(text)]
        if marks_close(text):
            text = text.replace(".", f" {BARE}.").replace(",", f" {BARE},")
        else:
            text = MARKS.sub(rf" {BARE}\g<0>", text)
        return BARE + text.replace("\n", f" {BARE}\n {BARE}")

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """Remember ids of units not seen before; those of long units, which hardly come again, are given back instead."""
        made: dict[str, bytes] = {}
        plain: dict[str, str] = {}
        words = []  # each is one piece
        for u in units:
            if len(u) <= 256 and (u[1:] if u[0] == BARE else u).isalpha():
                words.append(u)
            else:
                plain[u] = u[1:] if u[0] == BARE else " " + u

        def keep(units: list[str], ids: list[int], ends: np.ndarray) -> None:
            data, start = np.array(ids, "<u4").tobytes(), 0
            for u, end in zip(units, (4 * ends).tolist(), strict=True):
                made[u] = data[start:end]
                start = end

        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            data = "\n".join([u[1:] if u[0] == BARE else " " + u for u in some]).encode()
            tokens = list(map(self.tok.model.tokenize, CODES[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split("\n")))
            keep(some, [t.id for word in tokens for t in word], np.cumsum(list(map(len, tokens))))
        short = [u for u in plain if len(u) <= 256]
        if short:
            e = self.tok.encode([plain[u] for u in short], is_pretokenized=True, add_special_tokens=False)
            keep(short, e.ids, np.searchsorted(np.array(e.word_ids, np.int64), np.arange(1, len(short) + 1)))
        self.held.add(made)
        return {u: self.whole(plain[u]) for u in plain if len(u) > 256}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. Units are cut, told apart and joined as Arrow arrays; only the different ones of a call are looked up."""
        self.held.turn()
        every = "".join(filter(None, texts))
        odd, uneven = [x for x in self.odd if x in every], [x for x in UNEVEN if x in every]
        split = [self.units_of(t, odd, uneven) for t in texts]
        out = [self.whole(t) if t and s is None else b"" for s, t in zip(split, texts, strict=True)]
        even = [k for k, s in enumerate(split) if isinstance(s, str)]
        uneven = [k for k, s in enumerate(split) if isinstance(s, list)]
        if not even and not uneven:
            return out
        cut = pc.split_pattern(pa.array([split[k] for k in even], pa.large_string()), " ")
        units = pa.concat_arrays([cut.flatten(), pa.array([u for k in uneven for u in split[k]], pa.large_string())]).dictionary_encode()
        ends = np.cumsum([0, *pc.list_value_length(cut).to_pylist(), *(len(split[k]) for k in uneven)])
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.held.now.get, distinct))
        missing = [k for k, v in enumerate(values) if v is None]
        if missing:
            new = self.held.unknown([distinct[k] for k in missing])
            long = self.learn(new) if new else {}
            for k in missing:
                u = distinct[k]
                values[k] = long[u] if u in long else self.held.now[u]
        ids = pa.array(values, pa.large_binary()).take(units.indices)
        _, places, data = ids.buffers()
        at = np.frombuffer(places, np.int64)[ids.offset + ends].tolist()
        for k, start, end in zip(even + uneven, at, at[1:], strict=False):
            out[k] = data[start:end].to_pybytes()
        return out


def divide(lengths: list[int], windows: int) -> list[list[int]]:
    """Indexes of lengths in that many windows of nearly equal sums (Karmarkar-Karp, multiway)."""
    # A state is its parts that hold anything, fullest first; the others are empty. Its spread is what it adds to the imbalance.
    heap = [(-n, k, [(n, [k])]) for k, n in enumerate(lengths)]
    heapq.heapify(heap)
    ties = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(a) + len(b) - windows  # parts of each that must share a window, the emptiest of one with the fullest of the other
        if both <= 0:
            merged = a + b
        else:
            # a's i-th part meets b's (windows - 1 - i)-th
            merged = a[: windows - len(b)] + b[: windows - len(a)]
            for i in range(windows - len(b), len(a)):
                (x, p), (y, q) = a[i], b[windows - 1 - i]
                merged.append((x + y, p + q))
        merged.sort(key=lambda part: -part[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, ties, merged))
        ties += 1
    return [p for _, p in heap[0][2]] if heap else []


def windows_for(lengths: list[int], capacity: int) -> list[list[int]]:
    """The division into the fewest windows, from ceil(sum / capacity) up, in which no sum is over the capacity."""
    n = -(-sum(lengths) // capacity)
    while True:
        parts = divide(lengths, n)
        if all(sum(lengths[k] for k in p) <= capacity for p in parts):
            return parts
        n += 1


def pack(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = 1024, rows: int = 256) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of at most `capacity` ids.

    Columns: key, start and length (of the piece in its document's ids), ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset (in that sequence; gapless from 0). A document's ids end with END_ID; a null or empty text is that id alone. Repeated rows are
    packed as often as they come; other columns are left aside. An empty table gives no rows. Each input partition is packed by
    itself, without a shuffle; a worker holds `rows` texts and the rests of about WINDOWS sequences. sequence_id has the partition in its upper bits.
    """
    field = docs.schema[key]
    schema = StructType([field])
    for name in ("start", "length", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, LongType())
    schema = schema.add("ids", BinaryType())
    picked = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        sequence = (TaskContext.get().partitionId() << 33) - 1
        done: list[tuple] = []
        waiting: list[tuple] = []  # (key, start, ids, doc_tokens)
        total = 0
        kind = None

        def settle() -> None:
            nonlocal sequence, total
            for window in windows_for([len(w[2]) // 4 for w in waiting], capacity):
                sequence, offset = sequence + 1, 0
                for k in window:
                    doc, start, ids, tokens = waiting[k]
                    done.append((doc, start, len(ids) // 4, tokens, sequence, offset, ids))
                    offset += len(ids) // 4
            waiting.clear()
            total = 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), [kind, *[pa.int64()] * 5, pa.binary()], strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    full = n - n % capacity
                    for start in [*range(0, full, capacity), *range(full, n, min(REST, capacity))]:
                        if start < full:
                            sequence += 1
                            done.append((doc, start, capacity, n, sequence, 0, ids[4 * start : 4 * (start + capacity)]))
                        else:
                            piece = ids[4 * start : 4 * (start + REST)] if REST < capacity else ids[4 * start :]
                            waiting.append((doc, start, piece, n))
                            total += len(piece) // 4
                            spare = -total % capacity
                            if total >= WINDOWS * capacity and 3 * WINDOWS <= spare <= 8 * WINDOWS or total >= 2 * WINDOWS * capacity:
                                settle()
                if done:
                    yield batch()
        if waiting:
            settle()
            yield batch()

    return picked.mapInArrow(run, schema)
