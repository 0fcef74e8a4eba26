"""Cross-tokenizer alignment against the libraries on whole texts and plain loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from nutrilake.llm import alignment
from nutrilake.llm.bpe import byte_characters
from tests.conftest import SF_SMALL
from tests.llm.test_llm import AWKWARD, awkward, read

PATHS = public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)
ODD = ["a  b", " a", "  a ", "x ", "x  ", "a\n b", "a\n  b c", "a\n\n\n   b\t c", "  x     y", "x　 y z", "<|endoftext|> <s> </s> <0x41>", "it's we'LL 's", "▁a b", "a ▁b", "a\rb ;\r x",
       "日本語 テキスト と English", "🏳️‍🌈 " * 5, "\x1c \x1d a \x85 b", "᠎  x​  y", "a" * 300, "naïve café ﬁ", "ab " * 3000, "\u0000 a\u0000b", ".", " ", "\n", "  ", "x     z", "é" * 50 + " 漢字" * 40]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte_of = {c: i for i, c in enumerate(byte_characters())}

    def groups(text):
        """Groups of A and B ids by the whole text's tokens."""
        if not text:
            return []
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            return []
        out, ends = [], set(np.cumsum([len(x) for x in a_bytes]).tolist()) & set(np.cumsum([len(x) for x in b_bytes]).tolist())
        for ids, parts, side in ((a_ids, a_bytes, 0), (b_ids, b_bytes, 1)):
            at, upto, group = 0, 0, []
            for i, x in zip(ids, parts):
                group.append(i)
                upto += len(x)
                if upto in ends:
                    if side:
                        out[at] = (out[at], group)
                    else:
                        out.append(group)
                    at, group = at + 1, []
        return out
    return groups


def brute_force(plain, rows):
    found = [(i, plain(t)) for i, t in rows]
    links = [Counter((x, y) for g, h in groups for x in g for y in h) for _, groups in found]
    count = Counter(p for m in links for p in m)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, groups), m in zip(found, links):
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), m.total(), sum(n for p, n in m.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in m.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return Counter(out)


def test_groups_of_odd_texts(plain):
    for text in ODD:
        assert alignment.linked_ids(text, *PATHS) == plain(text), repr(text)


def test_groups_of_random_texts(plain):
    rng = np.random.default_rng(5)
    letters = list("ab é日 　\n\t\r .,'1😀") + ["  ", " the", "ing "]
    for _ in range(400):
        text = "".join(rng.choice(letters, rng.integers(1, 30)))
        assert alignment.linked_ids(text, *PATHS) == plain(text), repr(text)


def test_alignment_equals_brute_force(spark, plain):
    docs = read(spark, "documents", SF_SMALL)
    want = brute_force(plain, [(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, alignment.align(docs.repartition(3), *PATHS).collect())) == want


def test_alignment_awkward(spark, plain, monkeypatch):
    rows = AWKWARD + [(100 + i, t, None, None, None) for i, t in enumerate(ODD)]
    docs = awkward(spark, rows)
    got = alignment.align(docs, *PATHS)
    assert Counter(map(tuple, got.collect())) == brute_force(plain, [(r[0], r[1]) for r in rows])
    assert alignment.align(docs.limit(0), *PATHS).isEmpty()
    assert alignment.align(docs.where("text is null"), *PATHS).first().groups_sha256 == ""


def test_small_bounds_change_nothing(plain, monkeypatch):
    """Units, batches, lanes, stretches, wide groups and the memory of runs at their smallest."""
    rows = [(i, t) for i, t in enumerate(ODD + ["w" + " some more words, as text." * 40 + " ▁"])]
    for name, value in [("BATCH_BYTES", 40), ("LANE_TOKENS", 3), ("UNIT_ENTRIES", 30), ("KEPT_BYTES", 100), ("WIDE_GROUP", 2)]:
        monkeypatch.setattr(alignment, name, value)
    two = alignment.two_tokenizers(*PATHS)
    want = {r[0]: r for r in brute_force(plain, rows)}
    unit = alignment.Unit(two.a_bits + two.b_bits)
    for i, t in rows:
        if len(t) > 40:
            unit.add_long(i, two, t)
        else:
            unit.add([i], alignment.Merged(two, [t]))
    assert [r[:5] + r[5:] for r in unit.rows] == [want[i][:5] + want[i][7:] for i, _ in rows]
    merged = alignment.Merged(two, [t for _, t in rows])
    assert [len(g) and hashlib.sha256(g.encode()).hexdigest() or "" for g in merged.texts_of_groups()] == [want[i][7] for i, _ in rows]
