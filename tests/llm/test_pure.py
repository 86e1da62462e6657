"""The parts that need no cluster, against plain versions."""

import html
import json
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folioscan.llm import language, packing, pii, toxicity
from folioscan.llm.near_dedup import K, LEAST, shingle_sets, signatures
from folioscan.llm.queries import tokenizer_path
from folioscan.llm.tokens import Encoder, portions
from folioscan.llm.wavelet import WaveletError, WaveletMatrix, build


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 7, 300, 50256, 70000]), max_size=300))
def test_wavelet(ids):
    data = build(np.array(ids, np.uint32), [3, None], np.array([len(ids), 0]))
    w = WaveletMatrix(data)
    assert w.decode().tolist() == ids and w.doc_ids() == [3, None]
    assert [w.access(i) for i in range(len(ids))] == ids
    for token in {*ids, 5}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert w.count(token) == len(places)
        assert [w.select(token, j) for j in range(len(places) + 1)] == [*places, -1]
        assert [w.rank(token, i) for i in range(0, len(ids) + 1, 7)] == [sum(p < i for p in places) for i in range(0, len(ids) + 1, 7)]


def test_wavelet_blocks_and_damage():
    rng = random.Random(1)
    ids = [min(50000, int(rng.expovariate(0.01))) for _ in range(5000)]
    data = build(np.array(ids, np.uint32), [1], np.array([5000]))
    w = WaveletMatrix(data)
    for i in (0, 511, 512, 513, 4999):
        assert w.access(i) == ids[i] and w.rank(ids[i], i) == ids[:i].count(ids[i]) and w.select(ids[i], ids[:i].count(ids[i])) == i
    with pytest.raises(IndexError):
        w.access(5000)
    for bad in (b"", b"WRONG" + data, data[:-1], data[:20]):
        with pytest.raises(WaveletError):
            WaveletMatrix(bad)


def by_library(texts):
    """The library itself, text by text."""
    t = Tokenizer.from_file(tokenizer_path())
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_tokens_of_other_kinds(tmp_path):
    said = json.loads(open(tokenizer_path()).read())
    said["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(said))
    own = Encoder(str(tmp_path / "other.json"), 100)
    assert not own.cuts_words and Encoder(tokenizer_path(), 100).cuts_words
    assert own.encode(["a b", "b"]) == [np.array(own.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in ("a b", "b")]
    assert np.frombuffer(Encoder(tokenizer_path(), 100).encode(["a<|endoftext|>b"])[0], "<u4").tolist() == [64, 50256, 65]
    assert np.frombuffer(Encoder(tokenizer_path(), 100, special_as_text=True).encode(["a<|endoftext|>b"])[0], "<u4").tolist() == [64, 27, 91, 437, 1659, 5239, 91, 29, 65]


def test_tokens_equal_the_library():
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t", "a", "The", "ção", "'s", ",", "!!", "1.", "x9", " ", "\x1c", "😀", "<|endoftext|>", "-", "word" * 20]
    texts = ["", " ", *("".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(1500)), *(" ".join(rng.choices(bits[4:], k=30)) for _ in range(500))]
    expected = by_library(texts)
    for size in (300_000, 8):
        own = Encoder(tokenizer_path(), size)
        assert [x for p in portions(texts, 500) for x in own.encode(p)] == expected


def sequential_best_fit(items, capacity):
    gaps, n = [], 0
    for x in sorted(items, reverse=True):
        fitting = [g for g in gaps if g >= x]
        if fitting:
            gaps.remove(min(fitting))
            g = min(fitting)
        else:
            g, n = capacity, n + 1
        gaps.append(g - x)
    return n


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_fit(items):
    counts = {x: items.count(x) for x in set(items)}
    ordered, bins = sorted(items, reverse=True), {}
    for first, last, sequence, offset in packing.best_fit(counts, 40):
        for p in range(first, last):
            bins.setdefault(sequence + p - first, []).append((offset, ordered[p]))
    assert sum(map(len, bins.values())) == len(items) and len(bins) == sequential_best_fit(items, 40)
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= 40


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="aZ9.@-+ 0145()%ä", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_spans_of_long_runs():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)
    assert pii.base_spans("x 4111 1111 1111 1111 y")[0] == ("card", 2, 21)
    assert pii.sanitised("call +1 (017) 555-7713 or a.b@c.de now", pii.base_spans("call +1 (017) 555-7713 or a.b@c.de now")) == "call [PHONE] or [EMAIL] now"
    assert pii.term_spans("The Zorba met a@b.cd", {"zorba": "term", "b": "term"}, [("email", 14, 20)]) == [("term", 4, 9)]


def test_shingles_and_signatures():
    assert [len(s) for s in shingle_sets([None, "", "a", "a b", "A b c a b", "  x"], 2)] == [0, 0, 1, 1, 3, 1]
    one, two, other = shingle_sets(["a", "A", "a a"], 2)
    assert one.tolist() == two.tolist() != other.tolist()
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(400)]
    a, b = shingle_sets([" ".join(words), " ".join(words[:380] + ["z"] * 20)], 1)
    sig = signatures([a, b], K)
    inter = len(np.intersect1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - inter / (len(a) + len(b) - inter)) < 0.15 and LEAST == 4


def test_label_model():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    right = [0.9, 0.85, 0.8, 0.6, 0.9]
    votes = np.stack([np.where(rng.random(4000) < r, y, ~y) * 2 - 1 for r in right], 1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], 1)  # two that repeat the first
    model = toxicity.fit_label_model(votes, 0.2)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9
    assert model.weight[0] < 0.6 < model.weight[1] and model.table[2, 1, 2] > model.table[3, 1, 2]
    w, b = toxicity.fit_linear([np.array([0]) if v else np.array([1]) for v in y], y.astype(float) * 0.98 + 0.01, 2)
    assert w[0] + b > 0 > w[1] + b


def test_crc_of_pieces():
    assert zlib.crc32(np.array([0], "<u4").tobytes()) == zlib.crc32(b"\0\0\0\0")


def plainly_sanitised(text, spans):
    chosen = []
    for s in sorted(spans, key=lambda s: (s[1] - s[2], s[1])):
        if all(s[2] <= b or e <= s[1] for _, b, e in chosen):
            chosen.append(s)
    for kind, b, e in sorted(chosen, key=lambda s: -s[1]):
        text = text[:b] + pii.REPLACED[kind] + text[e:]
    return text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sorted(pii.REPLACED)), st.integers(0, 40), st.integers(1, 9)), max_size=12))
def test_overlapping_spans(found):
    text = "".join(chr(65 + k % 26) for k in range(50))
    spans = list({(b, b + n): (kind, b, b + n) for kind, b, n in found}.values())
    assert pii.sanitised(text, spans) == plainly_sanitised(text, spans)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 9.@", max_size=60))
def test_term_spans(text):
    terms, base = {"aaa": "term", "aba": "general", "bbb": "term"}, pii.base_spans(text)
    plain = [(terms[m[0]], *m.span()) for m in pii.WORD.finditer(text) if m[0] in terms and not any(m.start() < e and b < m.end() for _, b, e in base)]
    assert pii.term_spans(text, terms, base) == sorted(plain, key=lambda s: (s[0] != "term", s[1]))


def test_many_spans_in_a_text():
    text = "name ab@cd.ef zorbas " * 100_000
    began = time.process_time()
    base = pii.base_spans(text)
    spans = base + pii.term_spans(text, {"zorbas": "term"}, base)
    assert len(spans) == 200_000 and pii.sanitised(text, spans) == "name [EMAIL]  " * 100_000
    assert time.process_time() - began < 10  # about 0.6 s


def test_neighbours_and_contexts():
    """What is counted beside an entity is counted alike in the whole text."""
    text = "Yes one two three four five six seven a@b.cde eight 12 nine äb@x.yzz ten"
    found = list(pii.neighbours(text, pii.base_spans(text)[:1]))
    assert {t for t, _, _ in found} == {"two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "yzz"}
    everywhere = {(t, pii._context(a, b)) for t, a, b in pii.all_contexts(text)}
    assert {(t, c) for t, _, c in found} <= everywhere


OLD_HIDDEN = re.compile(r"<(script|style|nav|template)\b.*?</\1\s*>|<!--.*?-->", re.S | re.I | re.A)
OLD_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)
BITS = ["<script>", "</script >", "<STYLE a>", "</style>", "<nav", "</nav>", "<!--", "-->", "<html ", "lang='de'", " lang = en ", ">", "<", "text", "&amp;", " ", "<p>"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14))
def test_pages_in_one_pass(bits):
    page = "".join(bits)
    assert language.visible(page) == html.unescape(re.sub("<[^>]*>", " ", OLD_HIDDEN.sub(" ", page)))
    m = OLD_DECLARED.search(page)
    assert language.declared(page) == (m[1].lower() if m else None)


def test_long_broken_pages():
    began = time.process_time()
    for page in ("<script " * 100_000, "<" * 500_000, "<!--" * 100_000, "<html " * 100_000, "<html lang " * 50_000, "<nav></" * 100_000, "</script" * 100_000 + "<script>"):
        language.visible(page)
        language.declared(page)
    assert time.process_time() - began < 10  # about 0.5 s
