"""Encoding many texts with a tokenizers file, quickly and exactly.

BPE works on pre-tokens, so the ids of a text are those of its words, strung together. A batch of texts is cut
into words by Arrow, each different word is encoded once (many in one call) and remembered, and ids are gathered
by numpy. Cuts are only made where the file's own pre-tokenizer must cut; texts with white space that this can't
vouch for, and files with another kind of pre-tokenizer, are encoded whole. Special tokens' strings inside a text
are ordinary text.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: White space beyond ASCII's, and the separator: words or texts with these are encoded on their own.
_ODD = re.compile("[" + "".join(map(chr, (1, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: White space other than one blank or one line feed between two other characters.
_UNEVEN = re.compile(r"[\t\r\f\v]|[ \n][ \n]|\A[ \n]|[ \n]\Z")
_SEGMENTS = re.compile(r" ?[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
_TOGETHER = 128
CACHE_WORDS, TEXT = 500_000, 16


class Encoder:
    """About 2 * cache_words words are remembered, and those of one batch; texts of TEXT characters for each of
    cache_words are looked at together. So cache_words bounds the memory and is traded for time."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back that a batch no longer needs

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.kind, self.separator = self._kind(json.load(open(path, encoding="utf-8")))
        if self.kind == "spaceless" and len(self._whole(["\x01"])[0]) != 1:
            self.kind = "other"
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words

    @staticmethod
    def _kind(spec: dict) -> tuple[str, str]:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "bytes", "\n"
        steps = pre.get("pretokenizers", [])
        local = {"NFC", "Lowercase", "Replace"}
        norms = (norm or {}).get("normalizers", [])
        spaces = all(x["type"] in local and (x["type"] != "Replace" or (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ")) for x in norms)
        if spaces and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
            return "spaceless", " \x01 "
        return "other", ""

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes."""
        if len(self.cache) > self.cache_words:  # words that are met again come back from the older half
            self.older, self.cache = self.cache, {}
        found = list(map(self.cache.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing and self.older:
            get, put = self.older.get, self.cache
            for i in missing:
                if (ids := get(words[i])) is not None:
                    put[words[i]] = found[i] = ids
            missing = [i for i in missing if found[i] is None]
        own = [words[i] for i in missing]
        for i, ids in zip(missing, self._learn(own), strict=True):
            found[i] = ids
        self.cache.update(zip(own, (found[i] for i in missing), strict=True))
        return found

    def _learn(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        out: list[bytes] = [b""] * len(words)
        alone, rest = [], []
        for k in range(0, len(words), _TOGETHER):
            odd = _ODD.search("".join(words[k : k + _TOGETHER]))
            for i in range(k, min(k + _TOGETHER, len(words))):
                w = words[i]
                (alone if not w or w.isspace() or odd and _ODD.search(w) else rest).append(i)
        for i, ids in zip(alone, self._whole([words[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        mark, size = int(self._whole(["\x01" if self.kind == "spaceless" else "\n"])[0][0]), self.dtype.itemsize
        groups = [rest[i : i + _TOGETHER] for i in range(0, len(rest), _TOGETHER)]
        for k in range(0, len(groups), 256):
            some = groups[k : k + 256]
            for group, ids in zip(some, self._whole([self.separator.join([words[i] for i in g]) for g in some]), strict=True):
                at = np.flatnonzero(ids == mark)
                assert len(at) == len(group) - 1, "separator found inside a word"
                data, lo = ids.tobytes(), 0
                for i, hi in zip(group, [*(at * size).tolist(), len(data)], strict=True):
                    out[i] = data[lo:hi]
                    lo = hi + size
        return out

    def _even(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        array = pa.array(texts, type=pa.large_string())
        if self.kind == "spaceless":
            lists = pc.ascii_split_whitespace(array)
        else:
            lists = pc.split_pattern(pc.replace_substring(array, pattern="\n", replacement=" \n "), pattern=" ")
        ends = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        codes, different = np.asarray(coded.indices), coded.dictionary
        if self.kind == "bytes":  # a word has the blank before it with it, unless it begins a line
            line = pc.index(different, pa.scalar("\n", pa.large_string())).as_py()
            blank = np.ones(len(codes), dtype=bool)
            blank[ends[:-1][ends[:-1] < len(codes)]] = False
            feed = codes == line
            blank[feed] = False
            blank[1:][feed[:-1]] = False
            both = codes * 2 + blank
            used = np.flatnonzero(np.bincount(both, minlength=2 * len(different)))
            place = np.zeros(2 * len(different), dtype=np.int32)
            place[used] = np.arange(len(used))
            codes, plain = place[both], used & 1 == 0
            blanks = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), different, pa.scalar(" ", pa.large_string()))
            different = pc.if_else(pa.array(plain), different.take(pa.array(used >> 1)), blanks.take(pa.array(used >> 1)))
        ids = pa.array(self._words(different.to_pylist()), pa.large_binary())
        places = np.frombuffer(ids.buffers()[1], dtype=np.int64, count=len(ids) + 1) // self.dtype.itemsize
        flat = np.frombuffer(ids.buffers()[2], dtype=self.dtype, count=places[-1]) if places[-1] else np.zeros(0, dtype=self.dtype)
        starts, sizes = places[:-1], np.diff(places)
        each = sizes[codes]
        after = np.cumsum(each)
        out = flat[np.repeat(starts[codes] - (after - each), each) + np.arange(after[-1] if len(after) else 0)]
        bounds = np.concatenate([[0], after])[ends]
        return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        if self.kind == "other":
            return self._whole(texts)
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list[np.ndarray | None] = [None] * len(texts)
        even, chars = [], 0
        if self.kind == "bytes":
            array = pa.array(texts, type=pa.large_string())
            odd, uneven = (pc.match_substring_regex(array, p).to_pylist() for p in (_ODD.pattern, _UNEVEN.pattern.replace(r"\Z", r"\z")))
        for i, text in enumerate(texts):
            if self.kind == "spaceless":
                even.append(i)
            elif odd[i]:
                out[i] = self._whole([text])[0]
            elif uneven[i] or not text:
                out[i] = np.frombuffer(b"".join(self._words(_SEGMENTS.findall(text))), dtype=self.dtype)
            else:
                even.append(i)
            if even and even[-1] == i:
                chars += len(text)
            if chars > TEXT * self.cache_words:
                self._fill(out, even, texts)
                even, chars = [], 0
        self._fill(out, even, texts)
        return out  # type: ignore[return-value]

    def _fill(self, out: list, places: list[int], texts: list[str]) -> None:
        if places:
            for i, ids in zip(places, self._even([texts[i] for i in places]), strict=True):
                out[i] = ids


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One per file and Python worker; its memory of words lasts as long as the worker."""
    key = (path, cache_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, cache_words)
    return _ENCODERS[key]
