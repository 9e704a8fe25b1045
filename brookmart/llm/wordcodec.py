"""Batch encoding with the tokenizers and sentencepiece libraries, inside tasks.

Where a tokenizer drops white space before its merges, the ids of a text are those of its space-separated chunks in
order. So a space or line feed is a safe boundary: texts are cut there, each distinct chunk of a batch is encoded once
by the library, and the ids of a chunk are remembered up to a bound. Other tokenizers get whole texts in batches.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

#: Distinct chunks remembered by a task's process; beyond it the memory is emptied, which costs time only.
REMEMBERED = 800_000
#: Longer chunks are encoded each time they come.
LONGEST = 48
#: Stands between chunks that the library encodes as one text; chunks that hold it are encoded on their own.
MARK = b"\x01"
#: Bytes of texts whose chunks are looked up together.
GROUP = 1 << 22
#: Bytes of a text taken at a time.
PART = 1 << 18


def steps_of(part: dict | None, name: str) -> list[dict]:
    return (part or {}).get(name) or ([part] if part else [])


def keeps_chunks(spec: dict) -> bool:
    """Whether what the tokenizer does to a text before it is split does to each chunk what it does to the whole."""
    space = {"Regex": "\\s+"}
    return all(x.get("type") in ("NFC", "Lowercase") or (x.get("type") == "Replace" and x.get("pattern") == space and x.get("content") == " ") for x in steps_of(spec.get("normalizer"), "normalizers"))


def parts_stops(spec: dict) -> bool:
    """Whether a full stop or comma after a letter and before a space is a chunk of its own: the pattern has runs of letters
    and runs of what is neither letter, digit nor space, and nothing that mixes them."""
    first = steps_of(spec.get("pre_tokenizer"), "pretokenizers")[0]
    return {"[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"} <= set(others := first["pattern"]["Regex"].split("|")) and all(x in ("[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+", "[\\p{N}]", "[\\p{N}]+") or x.startswith("'") and x[1:].isalpha() for x in others)


def drops_space(spec: dict) -> bool:
    """Whether the library's tokenizer keeps only matches of a pattern that never match white space."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    first = steps[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    special = " ".join(x["content"] for x in spec.get("added_tokens", []))
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and "[^\\s" in pattern
        and "\\s" not in pattern.replace("[^\\s", "")
        and " ?" not in pattern
        and len(special.split()) == len(spec.get("added_tokens", []))
    )


class Codec:
    """Encodes batches of UTF-8 texts with the library for `path`."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.piece = path.endswith(".model")
        self.by_chunk = False
        if self.piece:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(path)
            self.model.no_truncation()
            self.model.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.by_chunk = drops_space(spec) and keeps_chunks(spec)
            self.lower = any(x.get("type") == "Lowercase" for x in steps_of(spec.get("normalizer"), "normalizers"))
            self.stops = self.by_chunk and parts_stops(spec)
        if self.by_chunk:
            mark = self.library([MARK.decode()])[0]
            self.by_chunk = len(mark) == 1
            self.mark = mark[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.lens, self.starts, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def library(self, texts: list[str]) -> list[list[int]]:
        """What the library itself gives."""
        if self.piece:
            return self.model.encode(texts, num_threads=1)
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        """Remembers the ids of new chunks. Many are one text to the library, with a chunk of one known id between them."""
        lens, pools = [self.lens], [self.pool]
        odd = [x for x in chunks if MARK in x or b"<|" in x or len(x) > LONGEST]
        even = list(set(chunks).difference(odd)) if odd else chunks
        found = self.library([x.decode() for x in odd]) if odd else []
        lens.append(np.fromiter(map(len, found), np.int64, len(found)))
        pools.append(np.fromiter((y for x in found for y in x), np.int32, int(lens[-1].sum())))
        between = b" " + MARK + b" "
        texts = [between.join(even[i : i + 256]).decode() for i in range(0, len(even), 256)]
        for i, ids in enumerate(self.library(texts) if texts else []):
            ids = np.asarray([*ids, self.mark], np.int32)
            at = np.flatnonzero(ids == self.mark)
            assert len(at) == len(even[256 * i : 256 * i + 256])
            lens.append(np.diff(at, prepend=-1) - 1)
            pools.append(ids[ids != self.mark])
        self._add([*odd, *even], lens, pools)

    def _add(self, chunks: list[bytes], lens: list[np.ndarray], pools: list[np.ndarray]) -> None:
        base = len(self.lens)
        self.known.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        self.lens, self.pool = np.concatenate(lens), np.concatenate(pools)
        self.starts = np.cumsum(self.lens) - self.lens

    def lowered(self, text: bytes) -> bytes:
        """Lower case, which joins equal chunks, where it cannot change the ids: if the tokenizer lower-cases, without special
        strings, and if the text is composed in either case (the library composes first), without a sigma (whose lower
        case depends on its place)."""
        if not self.lower or b"<|" in text:
            return text
        if text.isascii():
            return text.lower()
        whole = text.decode()
        low = whole.lower()
        return low.encode() if "\u03a3" not in whole and is_normalized("NFC", whole) and is_normalized("NFC", low) else text

    def chunks(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct chunks of all parts, the number of each chunk's, and how many chunks each part has. Where a full stop
        or comma between a letter a-z and a space is a chunk of its own to the tokenizer, a space is put before it."""
        parts = [self.lowered(x) for x in parts]
        body = np.frombuffer(b" ".join(parts) + b" ", np.uint8).copy()
        body[body == 10] = 32
        edges = np.cumsum([len(x) + 1 for x in parts])
        if self.stops:
            letter = (body >= 97) & (body <= 122)
            stop = np.flatnonzero(((body[1:-1] == 44) | (body[1:-1] == 46)) & letter[:-2] & (body[2:] == 32)) + 1
            body = np.insert(body, stop, 32)
            edges += np.searchsorted(stop, edges)
        ends = np.flatnonzero(body == 32)
        offsets = np.concatenate([[0], ends + 1]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        sizes = np.diff(np.searchsorted(ends, edges - 1, side="right"), prepend=0)
        return [x[:-1] for x in words.dictionary.to_pylist()], words.indices.to_numpy(), sizes

    def parts(self, text: bytes) -> list[bytes]:
        """A long text cut at spaces."""
        if len(text) <= PART:
            return [text]
        out, begin = [], 0
        while len(text) - begin > PART:
            if (cut := text.find(b" ", begin + PART)) < 0:
                break
            out.append(text[begin:cut])
            begin = cut + 1
        return [*out, text[begin:]]

    def encode(self, texts: list[bytes], end: int | None = None, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each text has, and all ids one after another (None if ids is False); end: an id put after each text."""
        if not self.by_chunk:
            found = self.library([x.decode() for x in texts])
            found = [[*x, end] for x in found] if end is not None else found
            n = np.fromiter(map(len, found), np.int64, len(found))
            return n, np.fromiter((y for x in found for y in x), np.int32, int(n.sum())) if ids else None
        counts, pools = np.zeros(len(texts), np.int64), []
        group: list[tuple[int, bytes, bool]] = []
        held = 0
        for i, text in enumerate(texts):
            parts = self.parts(text)
            for j, part in enumerate(parts):
                group.append((i, part, j == len(parts) - 1))
                held += len(part)
                if held >= GROUP:
                    self._some(group, end, ids, counts, pools)
                    group, held = [], 0
        self._some(group, end, ids, counts, pools)
        return counts, np.concatenate(pools or [np.zeros(0, np.int32)]) if ids else None

    def _some(self, group, end, ids, counts, pools) -> None:
        if not group:
            return
        distinct, number, sizes = self.chunks([part for _, part, _ in group])
        missing = [x for x in distinct if x not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.forget()
            missing = [x for x in distinct if x]
        long = [x for x in missing if len(x) > LONGEST]
        self.learn(missing)
        at = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[number]
        lens = self.lens[at]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(lens)])
        per = sums[edges[1:]] - sums[edges[:-1]]
        owner = np.fromiter((i for i, _, _ in group), np.int64, len(group))
        np.add.at(counts, owner, per)
        if end is not None:
            np.add.at(counts, owner[[last for _, _, last in group]], 1)
        if ids:
            total = int(sums[-1])
            out = self.pool[np.repeat(self.starts[at] - sums[:-1], lens) + np.arange(total)]
            if end is not None:
                ends = np.asarray([p for p, (_, _, last) in zip(sums[edges[1:]], group, strict=True) if last], np.int64)
                out = np.insert(out, ends, end)
            pools.append(out.astype(np.int32, copy=False))
        for x in long:  # their place in the pool stays unused until the memory is emptied
            del self.known[x]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker, kept between tasks."""
    return Codec(path)
