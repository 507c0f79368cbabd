"""Byte-level BPE by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens whose accepted sequences
are exactly the ones that applying the merges yields. It starts with one state in which every byte
loops. The gadget for a merge (a, b) -> c redirects the arcs labelled a to a copy of their target that
lacks the arc b, and adds an arc c to where b led, at every state that has an arc a.

All arcs of one label always share a target, so the state after a token is the target of that token.
A copy differs from its original by one missing arc, and tokens built later from a missing arc are
missing too. The automaton is therefore stored as three tables, of a size set by the vocabulary alone:

* ``lines[t]``: for the state after token t, the tokens in whose lines of copies it lies, each with the
  number of the merge at which it branched off;
* ``stems[t]``: the tokens that t begins with in its merge tree, each with the number of the merge that
  used it;
* ``missing``: (owner of the line, token) -> the number of the merge that took the arc away.

An accepted sequence that ends at a place of a word is the only one that does, so a word is encoded from
left to right with one state for each place; decoding emits the byte labels of the arcs.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, keep

#: The split pattern of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The letters and numbers that the pattern library knows and Unicode 16, the version of the
#: tokenizers library, does not; there they are neither.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The same pattern for texts with such characters.
SPLIT_LATER = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?![{LATER}])\p{{L}})+| ?(?:(?![{LATER}])\p{{N}})+| ?(?:[{LATER}]|[^\s\p{{L}}\p{{N}}])+|\s+(?!\S)|\s+"""
#: Bytes of words and their ids that a Python worker keeps in each of two generations, the bytes beyond which a
#: word is not kept, and the arcs that a worker keeps.
KEPT_BYTES = 20_000_000
LONGEST_KEPT = 64
KEPT_ARCS = 300_000
#: What Python itself needs for one kept word: two objects and a place in a table.
_ENTRY = 180
#: Marks that are a word of their own behind letters and before a space.
_ENDS = frozenset(".,;:!?")
#: Tokens in one Arrow batch that leaves a worker.
BATCH_TOKENS = 500_000
#: Numbers of merges lie below this one.
_NEVER = (1 << 31) - 1


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte, characters from 256 on for the rest, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The compiled automaton of a tokenizer file with its encoder and decoder."""

    def __init__(self, spec: dict):
        model, alphabet = spec["model"], byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.labels = {i: to_bytes(s) for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.lines: dict[int, list[tuple[int, int]]] = {}
        self.stems: dict[int, list[tuple[int, int]]] = {}
        self.missing: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        for b, t in self.ids.items():
            if len(b) == 1:
                self.lines[t], self.stems[t] = [(t, _NEVER)], [(t, _NEVER)]
        for number, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(number, self.ids[to_bytes(left)], self.ids[to_bytes(right)], self.ids[to_bytes(left + right)])
        self.accepted = {b: t for b, t in self.ids.items() if t in self.lines}
        self.finder = ahocorasick.Automaton()  # its trie alone is used
        for b in self.accepted:
            self.finder.add_word(b.decode("latin-1"), 0)
        self.longest = max(map(len, self.accepted), default=0)
        self.label_table = pa.array([self.labels.get(t) for t in range(max(self.labels, default=-1) + 1)], pa.binary())
        self.split, self.split_later, self.later = regex.compile(SPLIT).findall, regex.compile(SPLIT_LATER).findall, re.compile(f"[{LATER}]").search
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._pack()
        self.memory: dict[str, bytes] = {}  # words met lately
        self.older: dict[str, bytes] = {}  # those met before; what is not met again goes when the memory is full
        self.held = 0

    def _pack(self) -> None:
        """Lists of pairs become runs in flat arrays; tokens of other automata or not in use have empty ones."""
        top = max(self.lines, default=-1) + 1
        for name in ("lines", "stems"):
            lists = getattr(self, name)
            flat, starts = array("i"), array("i", [0])
            for t in range(top):
                for owner, limit in lists.get(t, ()):
                    flat.extend((owner, min(limit, _NEVER)))
                starts.append(len(flat))
            setattr(self, name, flat)
            setattr(self, f"{name}_at", starts)

    def runs(self, name: str, token: int) -> list[tuple[int, int]]:
        """The (owner or stem, number) pairs of a token in the compiled table ``lines`` or ``stems``."""
        flat, starts = getattr(self, name), getattr(self, f"{name}_at")
        run = flat[starts[token] : starts[token + 1]]
        return list(zip(run[::2], run[1::2], strict=True))


    def _gadget(self, number: int, a: int, b: int, c: int) -> None:
        if a not in self.lines or b not in self.lines or c in self.lines or not self._leads(self.lines[a], self.stems[b]):
            return
        self.lines[c] = [(c, _NEVER)] + [(r, min(limit, number)) for r, limit in self.lines[b]]
        self.stems[c] = [(c, _NEVER)] + [(p, min(limit, number)) for p, limit in self.stems[a]]
        self.missing[a, b] = number

    def _leads(self, lines: list[tuple[int, int]], stems: list[tuple[int, int]]) -> bool:
        for owner, branched in lines:
            for stem, used in stems:
                taken = self.missing.get((owner, stem))
                # a merge of a token with itself takes the arc away before its own arc is added
                if taken is not None and taken < branched and taken <= used:
                    return False
        return True

    def leads(self, after: int, token: int) -> bool:
        """Whether the state after one token has an arc for another."""
        key = after << 32 | token
        if (known := self.arcs.get(key)) is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._leads(self.runs("lines", after), self.runs("stems", token))
        return known

    def encode_word(self, word: bytes) -> bytes:
        """The one accepted sequence as 32-bit ids. From each place the longest label is tried first whose arc the state
        before has; a place from where none leads on is never come to again, as one token alone can end there."""
        if (whole := self.accepted.get(word)) is not None:
            return array("i", (whole,)).tobytes()
        find, arc, leads, begins, longest = self.accepted.get, self.arcs.get, self.leads, self.finder.longest_prefix, self.longest
        n, text, out, ends, dead, at, before = len(word), word.decode("latin-1"), [], [], set(), 0, -1
        end = begins(text[:longest])
        while at < n:
            while end > at:
                if (token := find(word[at:end])) is not None and end not in dead:
                    if before < 0:
                        break
                    allowed = arc(before << 32 | token)
                    if allowed or allowed is None and leads(before, token):
                        break
                end -= 1
            else:
                dead.add(at)
                end = ends.pop() - 1
                out.pop()
                at, before = (ends[-1], out[-1]) if ends else (0, -1)
                continue
            out.append(token)
            ends.append(end)
            at, before = end, token
            end = at + begins(text[at : at + longest])
        return array("i", out).tobytes()

    def _keep(self, word: str, ids: bytes) -> bytes:
        size = len(word) + len(ids)
        if size <= LONGEST_KEPT:
            if self.held >= KEPT_BYTES:
                self.memory, self.older, self.held = {}, self.memory, 0
            self.memory[word] = ids
            self.held += size + _ENTRY
        return ids

    def words(self, text: str) -> list[str]:
        """The words of the split pattern, as the tokenizers library finds them."""
        return self.split(text) if text.isascii() or not self.later(text) else self.split_later(text)

    def _apart(self, word: str) -> bytes:
        """The ids of a word of the split pattern. One behind a space is kept without it, any other, and white
        space, behind one more."""
        key = word[1:] if word[0] == " " and not word[1:2].isspace() and len(word) > 1 else " " + word
        got = self.memory.get(key)
        if got is None:
            got = self._keep(key, self.older.get(key) or self.encode_word(word.encode()))
        return got

    def _spaced(self, part: str) -> bytes:
        """The ids of a part of the text together with the one space before it."""
        got = self.older.get(part)
        if got is None:
            if part[-1:] in _ENDS and (stem := part[:-1]).isalpha():
                # the word alone is kept, not once more with each mark behind it
                return (self.memory.get(stem) or self._spaced(stem)) + self._apart(part[-1])
            words = [" " + part] if part.isalpha() else self.words(" " + part)
            got = self.encode_word(words[0].encode()) if len(words) == 1 else b"".join(map(self._apart, words))
            if "\n" in part:  # two lines seldom meet again
                return got
        return self._keep(part, got)

    def _plain(self, text: str, lone_space=re.compile(r" \s|\s |^ | $").search) -> bytes:
        """Where every space stands alone between other characters, the pattern always splits before it."""
        if lone_space(text):
            return b"".join(map(self._apart, self.words(text)))
        first, *rest = text.split(" ")
        new, out, i = self._spaced, [b"".join(map(self._apart, self.words(first)))], 0
        while i < len(rest):  # the memory changes when it is full, so that its method is named anew now and then
            known = self.memory.get
            out += [known(part) or new(part) for part in rest[i : i + 1000]]
            i += 1000
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]:
            if part in self.special:
                out.append(array("i", (self.special[part],)).tobytes())
            elif part:
                out.append(self._plain(part))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of many sequences, one from ``bounds[i]`` to ``bounds[i + 1]``: labels are put one behind another, and
        texts cut from them; where some are no UTF-8 each is decoded by itself."""
        labels = self.label_table.take(pa.array(ids))
        _, offsets, data = labels.buffers()
        places = np.frombuffer(offsets, np.int32, len(ids) + 1)[bounds]
        texts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(places.tobytes()), data)
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
        return texts


def load_spec(path: str) -> str:
    """The tokenizer file, read once on the driver; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_compiled: dict[int, Automaton] = {}


def _automaton(spec) -> Automaton:
    """The automaton of this worker; another tokenizer's goes, and other operators' memories with it."""
    if spec.id not in _compiled:
        forget()
        _compiled[spec.id] = Automaton(json.loads(spec.value))
    return _compiled[spec.id]


keep(_compiled)


class _Shared:
    """A broadcast value with an identity that workers can keep the compiled automaton under."""

    def __init__(self, spark, path: str):
        spec = load_spec(path)
        self.broadcast = spark.sparkContext.broadcast(spec)
        self.id = xxhash.xxh3_128_hexdigest(spec)  # of the content: a file may be written anew under its path

    @property
    def value(self) -> str:
        return self.broadcast.value


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token ids of every whole text and the text that they decode to.

    Returns the key, the ``keep`` columns, ``ids`` array<int> and ``decoded`` string; of these two names a kept
    column gives way. A null text counts as empty and gives no ids, a text of any length is encoded whole.
    Repeated rows and null keys stay as they are; an empty table gives an empty one.
    """
    kept = [key, *(c for c in keep or [] if c not in ("ids", "decoded"))]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text), F.lit("")).alias(fresh("_text", docs)))
    shared = _Shared(docs.sparkSession, tokenizer)
    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL("ids array<int>, decoded string").fields])

    def run(batches):
        automaton = _automaton(shared)
        for batch in batches:
            ids, start, size = [], 0, 0
            for row, t in enumerate(batch.column(len(kept))):
                got = automaton.encode(t.as_py())
                ids.append(got)
                size += len(got)
                if size >= BATCH_TOKENS or row == batch.num_rows - 1:
                    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    flat = np.concatenate(ids)
                    column, decoded = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), automaton.decoded(flat, offsets)
                    old = [batch.column(i).slice(start, len(ids)) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*old, column, decoded], names=[*kept, "ids", "decoded"])
                    ids, start, size = [], row + 1, 0

    return source.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of the ids, joined by commas, and of the decoded text."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
