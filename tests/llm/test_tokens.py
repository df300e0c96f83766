import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens as T

PATTERNS = ((T.SPACE, rb"[^\x20\x09-\x0D]+"), (T.ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9é東 \t\n\x0b-_\x00.", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, limit):
    for table, pattern in PATTERNS:
        got = []
        for lo, hi, data, offsets in T.chunks(pa.array(texts, pa.string()), limit):
            starts, ends, per = T.words(data, offsets, table)
            got += [[bytes(data[starts[j] : ends[j]]) for j in range(per[i], per[i + 1])] for i in range(hi - lo)]
        assert got == [re.findall(pattern, (t or "").encode()) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_tell_words_apart_and_windows_apart(texts):
    hasher, seen = T.Hasher(), {}
    for _, hi, data, offsets in T.chunks(pa.array(texts, pa.string())):
        starts, ends, per = T.words(data, offsets, T.SPACE)
        h = hasher(data, starts, ends)
        names = [bytes(data[a:b]) for a, b in zip(starts, ends)]
        for name, value in zip(names, h.tolist()):
            assert seen.setdefault(name, value) == value
        window, valid = T.window_hashes(h, per, 2)
        pairs = {}
        for i in np.flatnonzero(valid):
            assert pairs.setdefault((names[i], names[i + 1]), window[i]) == window[i]
        assert len(set(pairs.values())) == len(pairs)
        assert valid.sum() == sum(max(0, n - 1) for n in np.diff(per))
    assert len(set(seen.values())) == len(seen)


def test_lower_case_hashes_ignore_ascii_case_only():
    def one(text):
        _, _, data, offsets = next(T.chunks(pa.array([text])))
        return T.Hasher(lower=True)(data, *T.words(data, offsets, T.ALNUM)[:2]).tolist()

    assert one("ABC é") == one("abc é") and one("É") != one("é")


def test_normalised_keeps_marked_words():
    _, _, data, offsets = next(T.chunks(pa.array(["a  bb\tccc ", "", "d e"])))
    starts, ends, per = T.words(data, offsets, T.SPACE)
    joined, at = T.normalised(data, starts, ends)
    assert joined == b"a bb ccc d e " and at.tolist() == [0, 2, 5, 9, 11, 13]
    joined, at = T.normalised(data, starts, ends, np.array([True, False, True, False, True]))
    assert joined == b"a ccc e " and at.tolist() == [0, 2, 2, 6, 6, 8]


def test_words_that_collide_modulo_a_power_of_two():
    """Two words of the Thue-Morse sequence and its complement have equal polynomial hashes for every base; XXH64 tells them apart."""
    import numpy as np

    from millrace.llm.tokens import SPACE, Hasher, words

    bits = [bin(k).count("1") & 1 for k in range(2048)]
    text = ("".join("ab"[b] for b in bits) + " " + "".join("ba"[b] for b in bits) + " " + "".join("AB"[b] for b in bits)).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), SPACE)
    for lower in (False, True):
        h = Hasher(lower)(data, starts, ends)
        assert h[0] != h[1] and (h[0] == h[2]) == lower
