"""BPE encoding and decoding, exact for texts of any length.

A text is halved, wherever the middle falls, until the parts are short; all leaves of a batch of texts are encoded together, and neighbours are joined up the tree.
At each join a window around it is encoded anew, and grown until the outermost unit on either side is the one that this side's own encoding has at that place.
White space stands between that unit and the next, the tokenizer drops white space and looks at nothing beyond it, so from that agreement on the
two sides need no change. Units that come again in a task are looked up.

A run of more than a leaf without a space or line's end has no such units. It is halved and joined by itself, with windows of tokens: a window is grown
until its first token is one of the left side's and one of its later tokens is one of the right side's (same bytes, same place). A sequence of BPE
tokens is the encoding of its bytes exactly when each pair of neighbours is, so again the two sides need no change.

All this holds for tokenizers of the form that is checked in `of_known_form`; with any other one the library encodes whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ringwork.llm.held import LIMIT, Held

LEAF = 4096  # characters of a leaf; bytes of a leaf of an unsplit run
WINDOW = 32  # of the first window, on each side of a join
ODD_SPACE = "\x1c\x1d\x1e\x1f"  # white space to Python, not to the tokenizers
MARKS = re.compile(r"(?<=[^\W_])(?:[^\w\s']|_)+(?=[ \n]|\Z)")  # after a letter or digit, and before space
SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
# The normalizer and the first pre-tokenizer for which units between white space can be encoded by themselves.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
END_MARK = "</w>"

Span = tuple[int, int]


def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding; loaded once in each worker."""
    held = sys.modules[__name__].__dict__.setdefault("_tokenizers", {})
    if path not in held:
        from tokenizers import Tokenizer

        held[path] = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
    return held[path]


def of_known_form(tok) -> bool:
    """Whether a tokenizer lowers, drops white space, splits by SPLIT, and gives bytes as letters to a BPE model with END_MARK."""
    if tok.normalizer is None or tok.pre_tokenizer is None or getattr(tok.model, "end_of_word_suffix", None) != END_MARK:
        return False
    normalizers = json.loads(tok.normalizer.__getstate__()).get("normalizers")
    steps = json.loads(tok.pre_tokenizer.__getstate__()).get("pretokenizers") or [{}]
    return normalizers == NORMALIZERS and steps[0] == SPLIT and [(s["type"], s.get("add_prefix_space"), s.get("use_regex")) for s in steps[1:]] == [("ByteLevel", False, False)]


def marks_close(text: str) -> bool:
    """Whether each full stop and comma has a letter or digit before it and a space, a line's end or the end behind it."""
    for m in ".,":
        if text.count(m) != text.count(m + " ") + text.count(m + "\n") + text.endswith(m) or not all(p[-1:].isalnum() for p in text.split(m)[:-1]):
            return False
    return True


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> list[str]:
    """The letter by which byte-level tokenizers write each byte: itself if it is visible in Latin-1, else the next letter from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (chr(256 + k) for k in range(256))
    return [chr(b) if b in seen else next(hidden) for b in range(256)]


LETTERS = dict(enumerate(byte_letters()))


def as_letters(text: str) -> str:
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(LETTERS)


def leaves(n: int, leaf: int) -> list[Span]:
    """The parts of halving 0..n until none is longer than leaf."""
    todo, out = [(0, n)], []
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            out.append((a, b))
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return out


def up_the_tree(trees: list[list[tuple[int, int, object]]], join: Callable[[list[tuple]], list]) -> list:
    """The joined value of each tree, given as its leaves (start, end, value) in order.

    join: the values of (tree, start, middle, end, left, right), for all neighbours of a level, of all trees, at once.
    """
    trees = [list(t) for t in trees]
    while any(len(t) > 1 for t in trees):
        todo = [(k, t[i][0], t[i][1], t[i + 1][1], t[i][2], t[i + 1][2]) for k, t in enumerate(trees) for i in range(0, len(t) - 1, 2)]
        made = iter(join(todo))
        trees = [[(t[i][0], t[i + 1][1], next(made)) if i + 1 < len(t) else t[i] for i in range(0, len(t), 2)] for t in trees]
    return [t[0][2] for t in trees]


def window_of(left: list, right: list, at: int, end: int, reach: int) -> tuple[int, int, Span]:
    """How many tokens of the left side stand before a window of `reach` around `at`, how many of the right side are in it, and its place."""
    i = len(left)
    while i and left[i - 1][0] >= at - reach:
        i -= 1
    i, j = max(0, i - 1), 0
    while j < len(right) and right[j][0] < at + reach:
        j += 1
    return i, j, (left[i][0], right[j][0] if j < len(right) else end)


def agreed(left: list, right: list, i: int, j: int, window: list, at: int, whole: tuple[bool, bool]) -> list | None:
    """Both sides' tokens with those of the window between them; None if either side disagrees. whole: whether the window takes in all of a side."""
    if not whole[0] and window[0] != left[i]:
        return None
    if whole[1]:
        return left[:i] + window
    known = set(right[:j])
    for k, token in enumerate(window):
        if token[0] >= at and token in known:
            return left[:i] + window[: k + 1] + right[right.index(token) + 1 :]
    return None


def encode_long(word: str, encode_batch, leaf: int = LEAF) -> list[int]:
    """Ids of one unsplit piece of byte-level text, by tree concatenation. encode_batch(strings): the library's encodings of each as a word, made together."""

    def placed(spans: list[Span]) -> list[list[tuple[int, int, int]]]:
        """(place, length, id) of the tokens of parts of the word, each as if a word ended at its end."""
        out = []
        for (a, b), e in zip(spans, encode_batch([word[a:b] for a, b in spans]), strict=True):
            tokens, at = [], a
            for i, value in zip(e.ids, e.tokens, strict=True):
                n = len(value.removesuffix(END_MARK)) if at + len(value) > b else len(value)
                tokens.append((at, n, i))
                at += n
            out.append(tokens)
        return out

    def join(todo: list[tuple]) -> list:
        out, pending, reach = [None] * len(todo), list(range(len(todo))), WINDOW
        while pending:
            windows = [window_of(todo[k][4], todo[k][5], todo[k][2], todo[k][3], reach) for k in pending]
            for k, (i, j, (a, b)), window in zip(pending, windows, placed([w[2] for w in windows]), strict=True):
                _, start, middle, end, left, right = todo[k]
                out[k] = agreed(left, right, i, j, window, middle, (a == start, b == end))
            pending, reach = [k for k in pending if out[k] is None], 2 * reach
        return out

    spans = leaves(len(word), leaf)
    return [t[2] for t in up_the_tree([[(a, b, tokens) for (a, b), tokens in zip(spans, placed(spans), strict=True)]], join)[0]]


class Encoder:
    """Encodes and decodes with a word tokenizer that drops white space; one for each task. joins: how many joins of texts it has made."""

    def __init__(self, path: str, leaf: int = LEAF, limit: int = LIMIT):
        from tokenizers import Tokenizer

        self.tok, self.leaf = tokenizer(path), leaf
        self.known_form = of_known_form(self.tok)
        self.bare = Tokenizer(self.tok.model)  # words as they are
        self.held, self.joins = Held(limit), 0
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.plain = all(t == t.lower() and not re.search("[.,]", t) for t in self.special)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.run = re.compile(f"([^ \n]{{{leaf + 1},}})")  # what has no place to end a window

    def long_unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(unit) if self.cut else [unit]:
            if part in self.special:
                out.append(self.tok.token_to_id(part))
            elif part:
                for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(part)):
                    out += encode_long(piece, self.bare.encode_batch, self.leaf)
        return out

    def units_of(self, text: str) -> list[str]:
        """The units of a text; lowered, and with marks apart, where that is certain to change no id.

        Lowering is where each letter is lowered by itself and none takes a mark from its neighbour. Setting marks apart is where a letter or digit stands
        before them and space or the end behind: pieces end there anyway.
        """
        if any(c in text for c in ODD_SPACE):
            return [u for u in SPACE.split(text) if u]
        if not self.plain:
            return text.split()
        if is_latin(text) and not any(x in (lowered := text.lower()) for x in self.special):
            text = lowered
            if marks_close(text):
                text = text.replace(".", " .").replace(",", " ,")
            else:
                text = MARKS.sub(r" \g<0>", text)
        return text.split()

    def learn(self, units: set[str]) -> None:
        """Remember ids of units not seen before, as bytes of int32; single words by the model alone, other short ones in one call."""
        made: dict[str, bytes] = {}
        rest = []
        tokenize = self.tok.model.tokenize
        for u in units:
            if self.plain and u.isascii() and u.isalpha() and u.islower() and len(u) <= 256:  # one piece, which nothing changes
                made[u] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(u)])
            else:
                rest.append(u)
        short = [u for u in rest if len(u) <= 256]
        if short:
            e = self.tok.encode(short, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(1, len(short) + 1)) * 4
            ids, start = np.array(e.ids, "<i4").tobytes(), 0
            for u, end in zip(short, ends.tolist(), strict=True):
                made[u] = ids[start:end]
                start = end
        made.update((u, np.array(self.long_unit(u), "<i4").tobytes()) for u in rest if len(u) > 256)
        self.held.add(made)

    def known(self, split: list[list[str]]) -> dict[str, bytes]:
        """A table that has the ids of all these units."""
        if new := self.held.unknown(set().union(*split)):
            self.learn(new)
        return self.held.now

    def window(self, text: str, start: int, middle: int, end: int, reach: int) -> tuple[bool, bool, list[str], list[str], list[str]]:
        """Whether a window takes in all of either side, its units, and those of its parts before and after the middle."""
        a, b = start, end
        if middle - reach > start:
            a = max(start, text.rfind(" ", start, middle - reach) + 1, text.rfind("\n", start, middle - reach) + 1)
        if middle + reach < end:
            b = min((x for x in (text.find(" ", middle + reach, end), text.find("\n", middle + reach, end)) if x >= 0), default=end)
        return a == start, b == end, self.units_of(text[a:b]), self.units_of(text[a:middle]), self.units_of(text[middle:b])

    def join(self, texts: list[str], todo: list[tuple]) -> list[bytes]:
        out: list = [None] * len(todo)
        pending, reach = list(range(len(todo))), WINDOW
        self.joins += len(todo)
        while pending:
            windows = [self.window(texts[todo[k][0]], *todo[k][1:4], reach) for k in pending]
            ids = self.known([u for w in windows for u in w[2:]])
            for k, (whole_left, whole_right, both, x, y) in zip(pending, windows, strict=True):
                if (whole_left or x and both[0] == x[0]) and (whole_right or y and both[-1] == y[-1]):
                    left, right = todo[k][4:]
                    tail, head = sum(len(ids[u]) for u in x), sum(len(ids[u]) for u in y)
                    out[k] = b"".join([left[: len(left) - tail], *map(ids.__getitem__, both), right[head:]])
            pending, reach = [k for k in pending if out[k] is None], 2 * reach
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another (int32), and the places where texts begin and the last one ends."""
        if not self.known_form:
            ids = [np.array(e.ids, "<i4").tobytes() for e in self.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        else:
            self.held.turn()
            parts = [self.run.split(t) if t and len(t) > self.leaf else [t or ""] for t in texts]  # each second part is a run
            plain = [p for some in parts for p in some[::2]]
            spans = [leaves(len(p), self.leaf) for p in plain]
            split = [self.units_of(p[a:b]) for p, at in zip(plain, spans, strict=True) for a, b in at]
            table = self.known(split)
            coded = iter([b"".join(map(table.__getitem__, units)) for units in split])
            del split
            done = iter(up_the_tree([[(a, b, next(coded)) for a, b in at] for at in spans], lambda todo: self.join(plain, todo)))
            long = lambda run: b"".join(np.array(self.long_unit(u), "<i4").tobytes() for u in SPACE.split(run) if u)
            ids = [b"".join(long(p) if k % 2 else next(done) for k, p in enumerate(some)) for some in parts]
        return np.frombuffer(b"".join(ids), "<i4"), np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = LEAF, rows: int = 256, digests: bool = False) -> DataFrame:
    """keep columns, ids (array of int) and decoded (string) of each row's whole text; digests: n_tokens, ids_sha256 and decoded_sha256 in their place,
    made where the ids are, so that neither these nor the texts leave the worker.

    A null or empty text has no ids and decodes to an empty text; texts of any length are encoded whole; repeated rows are encoded as often as they come, and ties make no
    difference; other columns, whatever they are called, are left aside; an empty table gives no rows. One pass over the rows, no shuffle; a worker holds
    `rows` texts and a bounded table of units, which ends with the task.
    """
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = StructType([docs.schema[c] for c in keep])
    if digests:
        schema = schema.add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType())
    else:
        schema = schema.add("ids", ArrayType(IntegerType(), True)).add("decoded", StringType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                b = batch.slice(at, rows)
                ids, at_text = enc.encode(b.column(len(keep)).to_pylist())
                each = ids.tolist()
                each = [each[x:y] for x, y in zip(at_text.tolist(), at_text[1:].tolist(), strict=False)]
                decoded = enc.decode(each)
                if digests:
                    columns = [pa.array(np.diff(at_text).astype(np.int64)), pa.array([sha256(" ".join(map(str, x))) for x in each], pa.string()), pa.array(list(map(sha256, decoded)), pa.string())]
                else:
                    columns = [pa.ListArray.from_arrays(pa.array(at_text), pa.array(ids)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *columns], names=names)

    return picked.mapInArrow(run, schema)
