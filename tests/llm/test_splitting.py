from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.splitting import _WORD, split_oversized, split_text
from corpusmill.llm.tokens import VOCABULARY, encoding

TEXT = st.text(alphabet=st.sampled_from("ab. \n#,;!?\t" + chr(0xA0) + chr(0x2028)), max_size=400)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(-1, 14))
def test_pieces_fit_keep_all_words_and_share_no_more_than_allowed(text, size, overlap):
    parts = split_text(text, size, overlap)
    words = _WORD.findall(text)
    rebuilt = []
    for piece, start, end, shared in parts:
        own = _WORD.findall(piece)
        assert len(own) <= size or len(parts) == 1
        assert own == words[start:end]
        assert 0 <= shared <= max(0, min(overlap, size - 1))
        rebuilt += own[shared:]
    assert rebuilt == words
    if len(words) <= size:
        assert parts == [(text, 0, len(words), 0)]


def test_cuts_at_the_strongest_boundary():
    text = "One two three four. Five six\n\n# Head nine ten eleven. Twelve thirteen"
    assert [p[0] for p in split_text(text, 8, 0)] == ["One two three four. Five six", "# Head nine ten eleven. Twelve thirteen"]
    assert [p[0] for p in split_text("a b c d. e f g h", 5, 0)] == ["a b c d.", "e f g h"]


TOKENS = lambda t: len(encoding(VOCABULARY).encode_ordinary(t))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. \n#,;!?\tZq'" + chr(0xA0) + chr(0x2028) + chr(0xE9) + chr(0x4E2D)), max_size=200), st.integers(3, 12), st.integers(-1, 14))
def test_pieces_fit_in_tokens(text, size, overlap):
    parts = split_text(text, size, overlap, TOKENS)
    if TOKENS(text) <= size:
        assert [p[0] for p in parts] == [text]
    elif len(parts) > 1:
        least = max(0, size - max(0, min(overlap, size - 1)))
        assert all(TOKENS(p[0]) <= max(size, 4 if least < 4 else 0) for p in parts)
        letters = "".join(_WORD.findall(text))
        assert "".join(_WORD.findall(parts[0][0])) == letters[: len("".join(_WORD.findall(parts[0][0])))]
        assert parts[0][1] == 0 and all(p[1] + p[3] == q[2] for p, q in zip(parts[1:], parts, strict=False))
    else:
        assert TOKENS(parts[0][0]) <= size or len(parts[0][0]) <= 1


def test_a_word_larger_than_a_piece_is_cut_inside():
    word = "".join(chr(97 + i * 7 % 26) for i in range(500))
    parts = split_text(f"Some words first. {word} and more behind", 20, 4, TOKENS)
    assert all(TOKENS(p[0]) <= 20 for p in parts) and len(parts) > 5
    assert [p[0] for p in split_text("one two three. four five six", 4, 0, TOKENS)] == ["one two three.", "four five six"]


def test_tables(spark):
    schema = "id string, collection string, heading_path string, text string, size int, overlap int, _key string, piece_no int"
    rows = [
        ("a", "c", "H", "w " * 10, 4, 1, "x", 9),
        ("b", "c", None, None, 4, 1, "x", 9),
        ("c", None, "", "", 4, None, "x", 9),
        (None, "c", "", "w " * 9, None, 1, "x", 9),
        ("e", "c", "", "w " * 9, 0, 1, "x", 9),
        ("f", "c", "p", "long " * 50_000, 100, 10, "x", 9),
    ]
    df = spark.createDataFrame(rows, schema)
    out = split_oversized(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert len(by["a"]) == 3 and {r.heading_path for r in by["a"]} == {"H"} and all(r.words <= 4 for r in by["a"])
    assert [(r.piece_text, r.words) for r in by["b"]] == [(None, 0)] and [r.piece_text for r in by["c"]] == [""]
    assert len(by[None]) == 1 and len(by["e"]) == 1
    assert all(r.words <= 100 for r in by["f"]) and sum(r.words - r.shared_words for r in by["f"]) == 50_000
    assert split_oversized(df.limit(0)).count() == 0
    mixed = spark.createDataFrame([("t", "own " * 30, 10, 2, "some_base"), ("w", "own " * 9, 10, 2, "words"), ("n", "own " * 9, 10, 2, None), ("z", "x" * 90, 10, 2, "some_base")], "id string, text string, size int, overlap int, unit string")
    got = split_oversized(mixed, carry=()).collect()
    assert all(TOKENS(r.piece_text) <= 10 for r in got if r.id in "tz") and {r.id: r.pieces for r in got if r.id in "wn"} == {"w": 1, "n": 1}
    assert sum(r.words - r.shared_words for r in got if r.id == "t") == 30
