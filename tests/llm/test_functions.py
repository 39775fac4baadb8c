"""Parts of the operators against brute force, without Spark."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import crossparse, fingerprints, lines, neardup, packing, quality, textbatch, tiling, tokens, trigrams


def texts(seed, n, alphabet="aB c\né😀1.", most=40):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(most))) for _ in range(n)]


def test_word_hashes():
    many = [*texts(1, 300), "", None, "x" * 3000, "ab cd " * 400]
    pattern = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "") for t in many]
    words = [pattern.findall(t) for t in low]
    for chunk in (7, 1 << 20):
        textbatch.CHUNK = chunk
        h, at = textbatch.word_hashes(*textbatch.text_bytes(pa.array(many)))
        assert np.diff(at).tolist() == [len(w) for w in words]
        flat = [w for x in words for w in x]
        assert len({(a, int(b)) for a, b in zip(flat, h)}) == len(set(flat)) == len(set(h.tolist()))


def test_signature_estimates_overlap():
    r = random.Random(3)
    vocab = [str(i) for i in range(3000)]
    a = [r.choice(vocab) for _ in range(400)] + ["rep eat"] * 60
    for share in (0.02, 0.1):
        b = [r.choice(vocab) if r.random() < share else w for w in a]
        sig = neardup.signatures(pa.array([" ".join(a), " ".join(b), " ".join(a)]))
        true = neardup.overlap(neardup.bag(" ".join(a)), neardup.bag(" ".join(b)))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.2 and (sig[0] == sig[2]).all()
    assert not neardup.signatures(pa.array(["", None, "!!"])).any()


def test_bag_minhash_is_unbiased():
    g = np.random.Generator(np.random.PCG64(1))
    found = []
    for _ in range(60):
        x, y = g.integers(1, 2**63, (2, 20), dtype=np.uint64)
        wa, wb = g.integers(1, 9, (2, 20))
        a = np.concatenate([np.repeat(x, wa)])
        b = np.concatenate([np.repeat(x, wb), y[:5]])
        regs = neardup.bag_minhash(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        true = np.minimum(wa, wb).sum() / (np.maximum(wa, wb).sum() + 5)
        found.append((regs[0] == regs[1]).mean() - true)
    assert abs(np.mean(found)) < 0.02


def brute_tiles(a, b, least):
    used_a, used_b, out = set(), set(), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] != -1 and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        if best[0] < least:
            return out
        n, i, j = best
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(25))] for _ in range(2))
        assert sum(n for *_, n in tiling.tiles(a, b, 3)) == sum(n for *_, n in brute_tiles(a, b, 3))


def test_packing_fits_and_is_downsized():
    r = random.Random(2)
    for n in (0, 1, 7, 500):
        sizes = [r.randrange(1, 4097) for _ in range(n)]
        place, final = packing.pack(sizes)
        used = Counter()
        for s, (b, at) in zip(sizes, place):
            used[b] += s
            assert at + s <= final[b]
        assert all(min(c for c in packing.CAPACITIES if c >= used[b]) == c for b, c in enumerate(final))
        alone = sum(min(c for c in packing.CAPACITIES if c >= s) + packing.OVERHEAD for s in sizes)
        assert sum(final) + packing.OVERHEAD * len(final) <= alone


def phrases(data, refs, longest=crossparse.LONGEST):
    """Greedy factoring by brute force over lists of symbols."""
    n = i = 0
    held = {tuple(r[a:z]) for r in refs for a in range(len(r)) for z in range(a + 1, min(len(r), a + longest) + 1)}
    while i < len(data):
        k = 1
        while k < longest and i + k < len(data) and tuple(data[i : i + k + 1]) in held:
            k += 1
        i, n = i + k, n + 1
    return n


def test_cross_parsing():
    r = random.Random(7)
    for _ in range(300):
        ref, data = ([r.choice(b"abc") for _ in range(r.randrange(60))] for _ in range(2))
        assert crossparse.cross_phrases(data, crossparse.automaton(ref)) == phrases(data, [ref])
    assert crossparse.own_phrases(list(b"aababcabcd")) == 4 and crossparse.entropy(0, 0, 0) == (0.0, 0.0)
    assert crossparse.entropy(8, 3, 4) == (3 * math.log2(9) / 8, (3 * math.log2(9) - 4 * 2) / 8)


def test_match_lengths():
    r, size = random.Random(9), crossparse.LONGEST
    for _ in range(100):
        texts = [[r.randrange(1, 4) for _ in range(r.randrange(1, 40))] for _ in range(4)]
        texts.append(texts[0] * 2)
        places = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]
        tails = np.zeros((len(places), size), np.uint32)
        for row, (d, i) in zip(tails, places):
            row[: len(texts[d][i : i + size])] = texts[d][i : i + size]
        got = crossparse.match_lengths(lambda at, d: tails[at, d : d + crossparse.STEP], np.array([d for d, _ in places]))
        for (d, i), n in zip(places, got):
            held = [[x == y != 0 for x, y in zip(tails[j], tails[places.index((d, i))])] for j, (e, _) in enumerate(places) if e != d]
            assert n == max((x + [False]).index(False) for x in held)


def test_similarities(monkeypatch):
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    r = random.Random(21)
    texts = ["", "!!", "one two", "one two", "ab " * 60, "ab " * 90] + [" ".join(r.choices("abc", k=r.randrange(40))) for _ in range(30)]
    bags = [neardup.bag(t) for t in texts]
    for a, b in ((np.arange(36), np.arange(36)), (np.arange(4, 9), np.arange(9, 30)), (np.arange(2), np.arange(1))):
        want = [[neardup.overlap(bags[i], bags[j]) for j in b] for i in a]
        assert np.array_equal(neardup.similarities(pa.array(texts), a, b), want)
    assert not neardup.similarities(pa.array(["", None]), np.arange(2), np.arange(2)).any()


def test_extended_matches():
    r, size = random.Random(14), crossparse.LONGEST
    for _ in range(12):
        base = [r.randrange(1, 4) for _ in range(200)]
        texts = [base[r.randrange(60) :][: r.randrange(20, 180)] + r.choices((1, 2, 9), k=r.randrange(20)) for _ in range(5)] + [[7] * r.randrange(20, 90), [7] * 50]
        flat = np.array([w for t in texts for w in [*t, 0]], np.uint32)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        places = [(d, i) for d, t in enumerate(texts) for i in range(len(t) - size + 1)]
        same = lambda p, q: next((k for k, (x, y) in enumerate(zip([*texts[p[0]][p[1] :], 0], [*texts[q[0]][q[1] :], -1])) if x != y), None)
        want = {p: max((same(p, q) for q in places if q[0] != p[0]), default=0) for p in places}
        asked = [p for p in places if want[p] >= size]
        heads = {h: k for k, h in enumerate(sorted({tuple(texts[d][i : i + size]) for d, i in asked}))}
        doc, at = np.array([d for d, _ in asked]), np.array([begin[d] + i for d, i in asked])
        hashes = crossparse.Prefixes([(flat, crossparse.sums(flat))], np.zeros(len(at), np.int64), at)
        got = crossparse.extend(hashes, np.array([heads[tuple(texts[d][i : i + size])] for d, i in asked]), doc, begin[doc + 1] - 1 - at)
        assert got.tolist() == [want[p] for p in asked]


def test_tokens_match_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    count, library = tokens.counter(tokens.load(path)), Tokenizer.from_file(path)
    bits = [*"aAbß éÉΑΣσ' \x1c\x85​'1३² İı　日ﬁ😀\n\t_-!\x00", "<|endoftext|>", "<|startoftext|>", "<|endofTEXT|>", "'ll", "don't"]
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        assert count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_digests():
    a = b"The quick brown fox jumps over the lazy dog. " * 20
    d = [fingerprints.digest(x) for x in (a, a[:-100] + b"entirely other words stand here now", bytes(range(256)) * 4, b"", b"ab")]
    assert fingerprints.likeness(d[0], d[0]) == 1 and fingerprints.likeness(d[0], d[1]) > fingerprints.likeness(d[0], d[2])
    assert all(0 <= fingerprints.likeness(x, y) <= 1 and len(fingerprints.encode(x)) == 2 + fingerprints.BUCKETS // 2 for x in d for y in d)
    long = bytes(random.Random(1).choices(b"abcdef ", k=3 * 1000))
    whole = fingerprints.digest(long)
    fingerprints.PIECE, old = 101, fingerprints.PIECE
    assert (fingerprints.digest(long) == whole).all()
    fingerprints.PIECE = old


def test_network_learns_and_covers_every_byte():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(40)).encode() for _ in range(60)]
    bad = [" ".join(word() + "###" for _ in range(40)).encode() for _ in range(60)]
    m = quality.fit(bad[:40] + good[:40], [0] * 40 + [1] * 40, 0.5)
    assert sum(quality.probability(t, m) >= 0.5 for t in good[40:]) >= 18 and sum(quality.probability(t, m) < 0.5 for t in bad[40:]) >= 18
    m.table = r_table = np.random.Generator(np.random.PCG64(1)).normal(0, 1, m.table.shape).astype(np.float32)
    for n in (0, 1, 5, 6, 7, 8, 100, 101, 767, 768, 769, 770, 1531, 1532, 4000):
        data = bytes(r.randrange(1, 256) for _ in range(n))
        # by brute force: windows at every place of every chunk
        step, size = quality.CHUNK - quality.OVERLAP, quality.CHUNK
        parts = [data[i : i + size] for i in range(0, max(1, n - quality.OVERLAP), step)] if n >= 6 else [data + bytes(6 - n)]
        tops = [[max(max(m.bias[f] + sum(r_table[o, c[p + o], f] for o in range(6)) for p in range(len(c) - 5)), 0) for f in range(3)] for c in parts]
        want = np.array(tops)
        got = quality.features(data, m)
        assert np.allclose(got[:3], want.mean(0), atol=1e-4) and np.allclose(got[quality.FILTERS : quality.FILTERS + 3], want.max(0), atol=1e-4)
        for at in {0, n - 1, n - 2, n - 3} & set(range(n)):  # each byte is in a window
            assert any(at >= i + p and at < i + p + 6 for k, c in enumerate(quality.chunks(data)) for i in [k * step] for p in range(len(c) - 5))


def naive_digest(data):
    counts = [0] * fingerprints.BUCKETS
    for k, (i, j, m) in enumerate(fingerprints.TRIPLETS):
        for at in range(len(data) - m):
            h = sum(int(fingerprints.TABLES[t][data[at + o]]) for t, o in enumerate((i, j, m))) % 2**32
            counts[h * (0x9E3779B1 + 2 * k) % 2**32 >> 22] += 1
    order = sorted(counts)
    cuts = [order[len(order) * q // 4] for q in (1, 2, 3)]
    return [min(255, int(8 * math.log2(len(data) + 1))), *(sum(c > q for q in cuts) for c in counts)]


def test_digests_by_brute_force():
    r = random.Random(6)
    some = [bytes(r.randrange(97, 110) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 90, 700)]
    for x in some:
        assert fingerprints.digest(x).tolist() == naive_digest(x)
    for x in some:
        for y in some:
            a, b = naive_digest(x), naive_digest(y)
            body, head = sum(abs(p - q) for p, q in zip(a[1:], b[1:])) / (3 * fingerprints.BUCKETS), abs(a[0] - b[0]) / 64
            assert fingerprints.likeness(fingerprints.digest(x), fingerprints.digest(y)) == pytest.approx(max(0, 1 - 0.95 * min(1, 2 * body) - 0.05 * min(1, head)))


def naive_best_fit(sizes, caps, overhead, open_size):
    """Best fit by looking at every bin; (cost, bins)."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= s]
        if fits:
            min(fits, key=lambda b: b[0] - b[1])[1] += s
        else:
            bins.append([min((c for c in caps if c >= max(s, open_size)), default=max(caps)), s])
    final = [min(c for c in caps if c >= used) for _, used in bins]
    return sum(final) + overhead * len(final)


def least_cost(sizes, caps, overhead):
    """The cheapest packing of all, by trying every one."""
    best = [10**9]

    def place(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(min(c for c in caps if c >= b) + overhead for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= max(caps):
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_packing_by_brute_force():
    r, caps = random.Random(8), (8, 16, 32)
    total, least = 0, 0
    for _ in range(150):
        sizes = [r.randrange(1, 33) for _ in range(r.randrange(1, 8))]
        place, final = packing.pack(sizes, caps, 2)
        cost = sum(final) + 2 * len(final)
        assert least_cost(sizes, caps, 2) <= cost <= min(naive_best_fit(sizes, caps, 2, c) for c in caps)
        total, least = total + cost, least + least_cost(sizes, caps, 2)
    assert total <= 1.02 * least
    left = packing.Remaining([5, 5, 5, 3, 2], 16)
    left.count[5] -= 1
    assert left.filled(5, 16) == 15 and left.filled(5, 7) == 7 and left.largest(4) == 3 and left.largest(1) == 0


def test_tiles_of_repetitive_texts():
    import time

    began = time.time()
    assert tiling.tiles([1] * 100, [1] * 20_000, 4) == [(0, 0, 100)]
    assert sum(n for *_, n in tiling.tiles([1, 2] * 50, [1, 2, 1] * 3000, 3)) == sum(n for *_, n in brute_tiles([1, 2] * 50, [1, 2, 1] * 50, 3))
    assert time.time() - began < 20


@pytest.mark.parametrize("pattern, hit", [(r"(?i)(token|api_?key)=[a-z]+", "xx API_KEY=abc"), (r"AKIA[A-Z0-9]+", "AKIA1"), (r"[0-9a-f]{32,}", "0" * 32), (r"xox[abp]-[0-9]{10,}", "xoxb-1234567890"), (r"(foo|bar)+baz?", "foobarba")])
def test_trigram_queries_hold_for_matches(pattern, hit):
    assert re.search(pattern, hit)
    q, low = trigrams.derive(pattern), hit.lower()
    assert q.holds({low[i : i + 3] for i in range(len(low))})
    assert (q.kind == "all") == pattern.startswith("[0-9a-f]") and (q.kind == "all" or not q.holds(set()))


def test_line_keys():
    assert lines.keys_of(" A b\t\n\x0b\n\x85É ") == [b"a b", b"", "\x85É".encode()] and lines.keys_of(None) == [b""]
