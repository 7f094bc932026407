"""Token ids of many texts by the tokenizers library, with a memory of chunks met before.

Both vocabularies split a text before they merge bytes, and always between a non-space and a single space that a
non-space follows. Chunks cut there are encoded on their own with the same ids, so each distinct chunk goes to the
library once per worker and generation instead of at each occurrence."""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Chunks remembered per generation; two generations are alive, so memory stays bounded.
GENERATION = 500_000
#: Chunks longer than this are encoded but not remembered.
LONG = 64
#: Marks after a word that are a piece of their own in both vocabularies.
TAIL = ".,;:!?%&$*#|()[]{}<>/+=~^@\"-"
#: White space that keeps a text from being cut at its single spaces alone (Unicode's, beside space and newline).
WIDE_SPACES = ["  ", "\n ", " \n", "\t", "\x0b", "\x0c", "\r"]
SPACES = [*WIDE_SPACES, "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
#: What str.split() takes for white space and the vocabularies do not, and the byte that marks a raw key.
CONTROLS = ["\0", "\x1c", "\x1d", "\x1e", "\x1f"]
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = re.compile(rf"(?<=[^{_WHITE}])(?= [^{_WHITE}])")


class Encoder:
    """ids(texts): for each text its token ids as little-endian 16-bit numbers (all vocabularies here are smaller)."""

    def __init__(self, path: str, generation: int = GENERATION):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.generation = generation
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        mark = [self.library.token_to_id(t) for t in ("a</w>", "Ġa")]
        if self.library.get_vocab_size() > 1 << 16 or (mark[0] is None) == (mark[1] is None):
            raise ValueError("expects a vocabulary that marks word ends by </w> or word starts by Ġ, below 65,536 ids")
        self.by_end = mark[0] is not None
        self.edge = np.zeros(1 << 16, bool)
        for token, i in self.library.get_vocab().items():
            self.edge[i] = token.endswith("</w>") if self.by_end else token.startswith("Ġ")

    def chunks(self, text: str) -> list[str]:
        """The text's chunks as memory keys: a word stands for itself (after one space, where spaces have ids);
        after a zero byte come the very bytes to encode."""
        if any(c in text for c in CONTROLS) or not self.by_end and any(c in text for c in (WIDE_SPACES if text.isascii() else SPACES)):
            return ["\0" + c for c in SPLIT.split(text) if c]
        if self.by_end:  # white space and case carry no id; a final sigma is the one letter whose case depends on its place
            return (text if "Σ" in text else text.lower()).split()
        parts = text.split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def encode(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(self, keys: list[str]) -> dict[str, bytes]:
        """Ids of chunks not met yet. Plain words, without the marks after them, are joined to one text, whose ids are
        cut again at the vocabulary's marks; others are encoded one by one."""
        plain, odd, out, composed = set(), [], {}, []
        for c in keys:
            core = c if c.isalpha() else c.rstrip(TAIL)
            if not core.isalpha() or len(c) > LONG:
                odd.append(c)
                continue
            if core != c:  # marks after a word are split from it before bytes merge
                tail = c[len(core):] if self.by_end else "\0" + c[len(core):]
                composed.append((c, core, tail))
                if tail not in self.memory and tail not in self.older:
                    odd.append(tail)
                if core in self.memory or core in self.older:
                    continue
            plain.add(core)
        odd, plain = list(dict.fromkeys(odd)), list(plain)
        for at in range(0, len(plain), 2000):
            some = plain[at:at + 2000]
            ids = np.asarray(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(self.edge[ids])
            cuts = np.append(0, cuts + 1) if self.by_end else np.append(cuts, len(ids))
            if len(cuts) != len(some) + 1 or cuts[0] or cuts[-1] != len(ids):
                odd += some
                continue
            raw = ids.tobytes()
            out |= {c: raw[2 * a:2 * b] for c, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist())}
        for at in range(0, len(odd), 2000):
            some = odd[at:at + 2000]
            out |= dict(zip(some, self.encode([c[1:] if c[:1] == "\0" else c if self.by_end else " " + c for c in some])))
        ids_of = lambda c: out.get(c) or self.memory.get(c) or self.older[c]
        return out | {c: ids_of(core) + ids_of(tail) for c, core, tail in composed}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        memory, older = self.memory, self.older
        known, gaps, new = [], [], set()
        for text in texts:
            keys = self.chunks(text or "")
            ids = list(map(memory.get, keys))
            known.append(ids)
            for i in range(ids.count(None)):
                at = ids.index(None, at + 1 if i else 0)
                gaps.append((ids, at, keys[at]))
                new.add(keys[at])
        memory.update((c, older[c]) for c in new if c in older)
        new.difference_update(older)
        memory |= self.learn(list(new))
        for ids, i, c in gaps:
            ids[i] = memory[c]
        out = list(map(b"".join, known))
        for c in new:
            if len(c) > LONG:
                del memory[c]
        if len(memory) > self.generation:
            self.memory, self.older = {}, memory
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, generation: int = GENERATION) -> Encoder:
    """One encoder per worker process and vocabulary; it lives on between tasks, until one of them scans texts (see forget)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, generation)
    return _ENCODERS[path]


def forget() -> None:
    """Drop what this worker's encoders remember. Idle workers live on, and would hold it through every later stage."""
    _ENCODERS.clear()
