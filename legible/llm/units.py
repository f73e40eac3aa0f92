"""Cutting a text where byte-level BPE pre-tokenisation is independent on both sides.

In the pre-tokenisation pattern a match takes at most one blank before its word and never runs from a
non-blank into a blank, so a match always begins at a blank between two non-blank characters; a letter or
digit never shares a match with punctuation after it; and a line end between two non-blank characters is a
match of its own.  Texts where every blank, comma, full stop and line end stands like that are cut at all
of them; the few others only at blanks between non-blanks.  Between such cuts equal units give equal token ids:
each process remembers the ids of the units it has seen (bounded memory), and a text is the concatenation of
its units' ids.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Classes of bytes: blank, line end, other white space or zero, comma and full stop, letter or digit, above ASCII, the rest.
_CLASS = bytes(
    ord("s") if c == 32 else ord("n") if c == 10 else ord("x") if c in (0, 9, 11, 12, 13, 28, 29, 30, 31)
    else ord("p") if c in b",." else ord("h") if c > 127 else ord("a") if chr(c).isalnum() else ord("o") for c in range(256))
#: Neighbours that forbid the fine cut.
_NEVER = (b"x", b"ss", b"sn", b"ns", b"nn", b"sp", b"np", b"pp", b"op")

#: Units of one generation a process remembers (two are kept), and the longest unit worth remembering.
REMEMBER, LONGEST = 130_000, 200


def coarse(text: bytes) -> list[bytes]:
    """Units cut only at blanks between non-blanks."""
    return [u.encode() for u in _CUT.split(text.decode())]


def marked(text: bytes) -> bytes | None:
    """The fine cut of a UTF-8 text, a zero byte at every cut; None where it cannot hold.

    It holds if all its units are ``fine`` too."""
    kinds = text.translate(_CLASS)
    if kinds[:1] in (b"s", b"n") or kinds[-1:] in (b"s", b"n") or any(map(kinds.__contains__, _NEVER)):
        return None
    return text.replace(b" ", b"\0 ").replace(b",", b"\0,").replace(b".", b"\0.").replace(b"\n", b"\0\n\0")


#: Units that the fine cut may end where they end: no white space but a leading blank (or a line end alone), and no
#: last character above ASCII that is neither letter nor digit.
fine = re.compile(r"[ \n]?(?:\S*(?:[\x00-\x7f]|[^\W_]))?").fullmatch
#: One blank and a word: such units may be encoded in one string, one after the other.
plain = re.compile(r" \S+").fullmatch


#: The mark and a unit that no text has, for what follows every text.
_END = b"\0\xff"


class UnitMemo:
    """Token ids of texts by way of their units; ``encode`` turns a list of units into a list of little-endian
    unsigned 32-bit id bytes.

    Two generations of units are remembered: when the young one is full it becomes the old one, so units that
    keep coming stay known."""

    def __init__(self, encode):
        self._encode = encode
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def forget(self) -> None:
        """Forget all units, and what the encoder remembers of its own."""
        self._young, self._old = {}, {}
        getattr(self._encode, "forget", lambda: None)()

    def _known(self, us: list[bytes]) -> tuple[list[bytes], set[bytes]]:
        """ids of distinct units (each with its mark behind it), and those of them that are not fine (never remembered)."""
        got = list(map(self._young.get, us))
        gaps = [k for k, g in enumerate(got) if g is None]
        rough, new = set(), []
        for k in gaps:
            u = us[k]
            got[k] = self._old.get(u)
            if got[k] is None:
                new.append(k)
            else:
                self._young[u] = got[k]
        texts = [us[k][:-1].decode() for k in new]
        for k, t, ids in zip(new, texts, self._encode(texts)):
            got[k] = ids
            if not fine(t):
                rough.add(us[k])
            elif len(t) <= LONGEST:
                self._young[us[k]] = ids
        if len(self._young) > REMEMBER:
            self._old, self._young = self._young, {}
        return got, rough

    def ids(self, texts: list[bytes], end: bytes = b"", forced: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts in order, and the end of each text's (one more entry than texts).

        ``end``: id bytes after every text.  ``forced``: texts to be cut coarsely."""
        cut = [None if i in forced else marked(t) for i, t in enumerate(texts)]
        alone = {}  # texts that hold the mark themselves
        for i, m in enumerate(cut):
            if m is None:
                us = coarse(texts[i])
                cut[i] = b"" if b"\0" in texts[i] else b"\0".join(us)
                if b"\0" in texts[i]:
                    us = [u + b"\0" for u in us]
                    each = dict(zip(set(us), self._known(list(set(us)))[0]))
                    alone[i] = np.frombuffer(b"".join(map(each.__getitem__, us)) + end, "<u4")
        data = (_END + b"\0").join(cut) + _END + b"\0" if cut else b""
        stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
        # distinct units of the batch; a unit is followed by its mark here
        offsets = np.concatenate([[0], stops + 1]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy()
        last = np.cumsum([m.count(b"\0") + 2 for m in cut], dtype=np.int64)  # end of every text's units
        self._young[_END[1:] + b"\0"] = end
        found, rough = self._known(distinct)
        if rough:
            again = np.flatnonzero(np.array([u in rough for u in distinct])[which])
            more = frozenset(np.searchsorted(last, again, "right").tolist()) - forced
            more = {i for i in more if marked(texts[i]) is not None}
            if more:
                return self.ids(texts, end, forced | more)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32),
                                         pa.array(np.frombuffer(b"".join(found), "<u4")))
        flat = lists.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], last])] if len(texts) else np.zeros(1, np.int64)
        if alone:
            rows = [alone.get(i, flat[s:e]) for i, (s, e) in enumerate(zip(ends[:-1], ends[1:]))]
            flat, ends = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return flat, ends


_MEMOS: list[tuple[object, str, UnitMemo]] = []


def process_memo(source, name: str, encoder) -> UnitMemo:
    """The task process's memo for an encoder built from ``source`` (a broadcast value); kept between tasks."""
    for known, called, memo in _MEMOS:
        if known is source and called == name:
            return memo
    _MEMOS[:] = [(source, name, UnitMemo(encoder(source, name)))]
    return _MEMOS[0][2]
