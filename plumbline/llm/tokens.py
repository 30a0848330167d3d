"""Token ids of whole texts, as the tokenizers library gives them for a vocabulary file.

ByteLevel: the merges of a byte-level vocabulary run in tiktoken, several times as fast. Its ranks are built from
the very file, and the ids are the same (tests compare them); texts that tiktoken may read otherwise (special
tokens' strings) go through the tokenizers library.

Words: a vocabulary whose pre-tokenizer drops white space gives a text the ids of its words in a row, so each
distinct word is encoded once per worker, by the tokenizers library, and kept in a bounded cache. Unknown words
are encoded many at a time as one text. Words of Latin letters alone are one piece each whatever stands around them; they
skip the file's normalizer and pre-tokenizer (their effect on such words is plain: composed form, lower case), and
a full stop or comma after them is a piece of its own.
"""

from __future__ import annotations

import functools
import json
import re

#: Words in each of a worker's two generations of cached words.
CACHE_WORDS = 250_000
#: Longer words are encoded each time.
LONGEST_CACHED = 40
#: Words of Latin letters up to U+024F; a dotted capital I becomes two characters and is left out.
_LATIN = "^[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+$"
_latin = re.compile(_LATIN)
#: Texts on which rebuilt tables are compared with the library when a file is loaded: contractions, digits, marks, scripts, runs of white space.
PROBES = ("", " ", "It's  a\ttest, isn't\nit?\n\n  Yes: 1234.50 (x_y)!", "Straße naïve œuvre ñandú Ωμέγα привет 你好 🙂🙂 e\u0301 \u00a0\u2003x", "a" * 300, "the The THE 's 'S we'll I'd", "\x00\x1f\x7f\ufffd")
#: The pattern that parts texts before byte-level merges (a fixed value of such vocabularies).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _packed(encodings) -> list[bytes]:
    import numpy as np

    return [np.asarray(e.ids, dtype="<u4").tobytes() for e in encodings]


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, and the byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """ids(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, spec: dict):
        import tiktoken

        byte, special = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("from-file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = _library(path)
        #: Whether the tables give what the library gives; if they don't, every text goes through the library.
        self.same = all(self.fast.encode_ordinary(t) == self.library.encode(t, add_special_tokens=False).ids for t in PROBES)

    def ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        if not self.same:
            return _packed(self.library.encode_batch(texts, add_special_tokens=False))
        out = []
        for t in texts:
            if self.special and self.special.search(t):
                out += _packed([self.library.encode(t, add_special_tokens=False)])
            else:
                out.append(np.asarray(self.fast.encode_ordinary(t), dtype="<u4").tobytes())
        return out


    def ragged(self, texts, end_id: int):
        """The same for an Arrow array of texts, each followed by end_id: offsets and all ids."""
        import numpy as np

        end = int(end_id).to_bytes(4, "little")
        data = [x + end for x in self.ids(texts.to_pylist())]
        return np.cumsum([0, *(len(x) // 4 for x in data)]), np.frombuffer(b"".join(data), "<u4")


class Words:
    """ids(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    _odd = re.compile(r"[\x1c-\x1f]|<\|")  # what str.split() takes for white space and the vocabulary does not; special tokens

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import pre_tokenizers

        self.library = _library(path)
        self.separator = "\x07"
        self.separator_id = self.library.encode(self.separator, add_special_tokens=False).ids
        #: The same merges on words that are normalized and mapped to byte symbols already.
        self.lean = _library(path)
        self.lean.normalizer = None
        self.lean.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.symbols = {b: c for c, b in byte_symbols().items() if c != "\u0120"}  # but the space, which parts words
        vocab = self.lean.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.marks = {m: self._whole([m])[0] for m in ".,"}
        #: Two generations: when the young one is full it becomes the old one, and what is used again moves back.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return _packed(self.library.encode_batch(texts, add_special_tokens=False)) if texts else []

    def _joined(self, words: list[str]) -> list[bytes]:
        import numpy as np

        if len(self.separator_id) != 1 or not words:
            return self._whole(words)
        ids = np.asarray(self.library.encode(f" {self.separator} ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = (4 * np.append(np.nonzero(ids == self.separator_id[0])[0], len(ids))).tolist()
        if len(ends) != len(words):
            return self._whole(words)
        data = ids.tobytes()
        return [data[s:e] for s, e in zip([0, *(x + 4 for x in ends[:-1])], ends, strict=True)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of lower-case words of Latin letters."""
        import numpy as np

        if not words:
            return []
        mapped = " ".join(words).encode().decode("latin-1").translate(self.symbols)
        ids = np.asarray(self.lean.encode(mapped, add_special_tokens=False).ids, dtype="<u4")
        ends = (4 * (np.nonzero(self.ends_word[ids])[0] + 1)).tolist()
        if len(ends) != len(words):
            return self._whole(words)
        data = ids.tobytes()
        return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def _find(self, missing: set[str]) -> dict[str, bytes]:
        """The ids of words of any kind."""
        old, found, letters, other = self.old, {}, {}, []
        for k in missing:
            if not k:
                found[k] = b""
            elif (i := old.get(k)) is not None:
                found[k] = i
            else:
                stem, mark = (k[:-1], k[-1]) if k[-1] in ".," else (k, "")
                if _latin.match(stem):
                    letters[k] = (stem.lower(), mark)
                else:
                    other.append(k)
        stems = list({w for w, _ in letters.values()})
        known = dict(zip(stems, self._stems(stems), strict=True)) if stems else {}
        for k, (w, mark) in letters.items():
            found[k] = known[w] + self.marks[mark] if mark else known[w]
        plain = [k for k in other if self.separator not in k]
        odd = [k for k in other if self.separator in k]
        found.update(zip(plain, self._joined(plain), strict=True))
        found.update(zip(odd, self._whole(odd), strict=True))
        return found

    def ids(self, texts: list[str]) -> list[bytes]:
        keys = [None if self._odd.search(t) else (t.lower() if t.isascii() else t).split() for t in texts]
        get = self.young.get
        parts = [None if k is None else list(map(get, k)) for k in keys]
        gaps = [(k, p) for k, p in zip(keys, parts, strict=True) if p and None in p]
        if gaps:
            found = self._find({w for k, p in gaps for w, i in zip(k, p, strict=True) if i is None})
            for k, p in gaps:
                p[:] = [found[w] if i is None else i for w, i in zip(k, p, strict=True)]
            self.young.update((k, i) for k, i in found.items() if len(k) <= LONGEST_CACHED)
            if len(self.young) > CACHE_WORDS:
                self.old, self.young = self.young, {}
        odd = iter(self._whole([t for t, k in zip(texts, keys, strict=True) if k is None]))
        return [next(odd) if p is None else b"".join(p) for p in parts]


    def _stems(self, stems: list[str]) -> list[bytes]:
        """The ids of distinct lower-case words of Latin letters, from the cache or else encoded together."""
        ids = list(map(self.young.get, stems))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            known = list(map(self.old.get, [stems[i] for i in gaps]))
            fresh = [i for i, x in zip(gaps, known, strict=True) if x is None]
            for i, x in zip(gaps, known, strict=True):
                ids[i] = x
            for i, x in zip(fresh, self._letters([stems[i] for i in fresh]), strict=True):
                ids[i] = x
            self.young.update((stems[i], ids[i]) for i in gaps if len(stems[i]) <= LONGEST_CACHED)
            if len(self.young) > CACHE_WORDS:
                self.old, self.young = self.young, {}
        return ids

    def ragged(self, texts, end_id: int):
        """The same for an Arrow array of texts, each followed by end_id: offsets and all ids.

        Arrow parts the texts, numbers their distinct words, and gathers ids by number; a word of letters is its stem and perhaps a mark,
        and only distinct stems and other words are looked up one by one.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        end = int(end_id).to_bytes(4, "little")
        if pc.any(pc.match_substring(texts, "<|")).as_py():
            data = [x + end for x in self.ids(texts.to_pylist())]
            return np.cumsum([0, *(len(x) // 4 for x in data)]), np.frombuffer(b"".join(data), "<u4")
        lists = pc.ascii_split_whitespace(texts)
        at = lists.offsets.to_numpy().astype(np.int64)
        numbered = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at, words = at - at[0], numbered.dictionary
        dot, comma = (pc.ends_with(words, m).to_numpy(zero_copy_only=False) for m in ".,")
        marked = dot | comma
        bare = pc.if_else(pa.array(marked), pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.match_substring_regex(bare, _LATIN).to_numpy(zero_copy_only=False)
        stems = pc.utf8_lower(bare.filter(pa.array(plain))).dictionary_encode()
        rest = words.filter(pa.array(~plain)).to_pylist()
        found = self._find(set(rest)) if rest else {}
        units = [*self._stems(stems.dictionary.to_pylist()), *(found[w] for w in rest), self.marks["."], self.marks[","], end]
        n_stems, n = len(stems.dictionary), len(units)
        # A word's units: its stem or itself, and its mark; one more word stands for the end of a text.
        first = np.empty(len(words) + 1, np.int32)
        first[:-1][plain] = stems.indices.to_numpy()
        first[:-1][~plain] = n_stems + np.arange(len(rest))
        first[-1] = n - 1
        two = np.append(plain & marked, False)
        place = np.concatenate(([0], np.cumsum(1 + two))).astype(np.int32)
        parts = np.empty(place[-1], np.int32)
        parts[place[:-1]] = first
        parts[place[:-1][two] + 1] = np.where(dot[two[:-1]], n - 3, n - 2)
        size = np.fromiter(map(len, units), np.int64, n) // 4
        pool = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(np.frombuffer(b"".join(units), "<u4")))
        own = pool.take(pa.array(parts))  # the ids of each unit of each distinct word
        by_word = pa.ListArray.from_arrays(pa.array(own.offsets.to_numpy()[place]), own.values)
        codes = np.insert(numbered.indices.to_numpy(), at[1:], len(words))
        flat = by_word.take(pa.array(codes))
        ends = flat.offsets.to_numpy()[np.concatenate(([0], at[1:] + np.arange(1, len(at))))].astype(np.int64)
        return ends, flat.values.to_numpy()


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return ByteLevel(path, spec)
    return Words(path)


def row_slices(column, most_bytes: int = 4 << 20):
    """(first, rows) of runs of an Arrow string column of about so many bytes, or of one longer text."""
    import numpy as np

    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        n = max(1, int(np.searchsorted(ends, before + most_bytes, side="right")) - first)
        yield first, n
        first += n


def slices(values: list, rows: int = 512):
    """Lists of at most so many values: what a worker holds at once is bounded by these, not by Arrow's batches."""
    for i in range(0, len(values), rows):
        yield values[i : i + rows]
