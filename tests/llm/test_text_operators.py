"""PII, substring dedup, I-Match, language model, language ID, BPE and packing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import by_row, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import bpe, imatch, langid, ngram_lm, packing, pii, queries, substring
from graphloom.llm.common import Words, blocks, remainder

PATH = public_tokenizers.path("word_bpe_49k.json")


# --- the kernel ------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a b  a", None, "", " \n", "x\ty é", "ab" * 50, "a"]
    seen = {}
    for limit in (1, 7, 1 << 20):
        for lo, hi, buf, offs in blocks(pa.array(texts), limit):
            w = Words(buf, offs)
            raw = buf.tobytes()
            got = [raw[s:e].decode() for s, e in zip(w.start, w.end, strict=True)]
            assert got == [x for t in texts[lo:hi] for x in words_of(t)]
            for text, h in zip(got, w.hash, strict=True):
                assert seen.setdefault(text, h) == h
            out, at = w.joined()
            assert [out[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [" ".join(words_of(t)) for t in texts[lo:hi]]
    assert len(set(seen.values())) == len(seen)


def thue_morse(n: int = 1024) -> tuple[str, str]:
    """Two words that every polynomial hash modulo 2**64 confuses."""
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_structured_words_do_not_clash():
    words = [w for n in (64, 1024, 2048, 4096) for w in thue_morse(n)] + ["a", "aa", "a\0", "a" * 8, "a" * 9, "a" * 16, "a" * 17]
    _, _, buf, offs = next(blocks(pa.array([" ".join(words), *words])))
    w = Words(buf, offs)
    assert len(set(w.hash.tolist())) == len(words) and (w.hash[: len(words)] == w.hash[len(words) :]).all()


# --- PII -------------------------------------------------------------------------------------------------------------


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
            if (k == 1 and max(map(int, m[0].split("."))) > 255) or (k == 2 and not (12 <= len(d) <= 19 and total % 10 == 0)) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_rules_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("ab.-_@@ +()0123459é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("0" * 50_000 + ".1.1.1") == [(0, 50_006, 1)]


def test_pii_query_keeps_base_spans(ready, docs):
    m = pii.train(docs)
    rows = by_row(pii.detect(docs, m, ["doc_id", "text"], redact=True))
    assert len(rows) == docs.count()
    for r in rows:
        base = plain_spans(r.text or "")
        told = pii.told(base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, _, k in base) for j in range(4)]
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
        if not re.search(r"[0-9@]|\(at\)|\[at\]", r.text or ""):
            assert r.spans == "" and r.redacted == r.text
    assert pii.detect(docs.limit(0), m, ["doc_id"]).count() == 0


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    m = pii.Tagger.fresh(rng)
    for p in m.parts():
        p[...] = rng.standard_normal(p.shape) * 0.3
    m = pii.Tagger(m.embed.astype(float), [w.astype(float) for w in m.lstm], m.out.astype(float), m.step.astype(float))
    x, y = pii.training_windows([], 3)
    _, grads = pii._loss(m, x, y)
    for p, g in zip(m.parts()[1:], grads[1:], strict=True):
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-4
        up = pii._loss(m, x, y)[0]
        p[at] -= 2e-4
        down = pii._loss(m, x, y)[0]
        p[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[at]) < 1e-3 * max(1, abs(g[at]))


def test_tagger_finds_what_rules_miss_and_leaves_clean_text():
    x, y = pii.training_windows([], 4000)
    m = pii.fit(x, y)
    xt, yt = pii.training_windows([], 500, seed=77)
    assert (pii.decode(m, xt) == yt).mean() > 0.93
    assert all(p > 0.8 and r > 0.8 for p, r in pii.held_out_quality(m).values()), pii.held_out_quality(m)
    at = "please write to jane.doe (at) example.com about the rest of it"
    assert [(a, b, k) for a, b, k in pii.find_spans([at], m)[0][1]] == [(16, 41, 0)]
    found = pii.find_spans(["card 4111.1111.1111.1111 now", "version 3.2.1 of 2024-01-02 costs 3,200", "no data"], m)
    assert [(a, b, k) for a, b, k in found[0][1]] == [(5, 24, 2)]
    assert found[1][1] == [] and found[2][1] == []


# --- substring dedup -------------------------------------------------------------------------------------------------


def plain_dedup(rows: list[tuple], k: int) -> list[tuple]:
    owner: dict = {}
    for d, t in rows:
        if d is not None:
            w = words_of(t)
            for i in range(len(w) - k + 1):
                owner[tuple(w[i : i + k])] = min(owner.get(tuple(w[i : i + k]), d), d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if d is not None and owner[tuple(w[i : i + k])] < d:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window", [13, 6])
def test_substrings(docs, window):
    got = by_row(substring.remove_repeats(docs, ["doc_id", "text", "n_words"], window, kept_text=True))
    want = plain_dedup([(r.doc_id, r.text) for r in docs.collect()], window)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)


def test_substrings_of_random_texts(ready, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(60 + i, "p q r s " + w + " t u v w") for i, w in enumerate((*thue_morse(), *thue_morse()))]
    got = by_row(substring.remove_repeats(ready.createDataFrame(rows, "doc_id long, text string"), ["doc_id"], 7, kept_text=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == Counter(plain_dedup(rows, 7))
    assert substring.remove_repeats(empty, ["doc_id"]).count() == 0


# --- I-Match ---------------------------------------------------------------------------------------------------------


def test_imatch(docs):
    rows = by_row(imatch.fingerprint(docs, parts=3))
    order = sorted([(r.doc_id is not None, r.doc_id or 0, r.text or "", r.doc_id) for r in docs.collect()])
    want = []
    for i, (_, _, text, d) in enumerate(order):
        nxt = order[(i + 1) % len(order)][2]
        q = len(text) // 4
        want.append((d, len(text), hashlib.sha256((text[: len(text) - q] + nxt[:q]).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == Counter(want)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].fingerprint == by_id[1].fingerprint == by_id[None].fingerprint and by_id[0].near_next == 1
    assert by_id[4].fingerprint == "" and by_id[4].near_next == 1.0  # followed by another empty one
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert imatch.fingerprint(docs.limit(0)).count() == 0


def plain_print(terms, lexicon):
    """The fingerprint of a set of term hashes by the definition."""
    own = sorted(terms & lexicon or terms)
    if not own:
        return ""
    wide = lambda v: np.array([v & (2**64 - 1)], np.uint64)
    slots = [min(len(own), 65535)]
    for k in range(imatch.SLOTS):
        seed, inside = int(imatch._SEEDS[k]), []
        for h in own:
            v = int(imatch.mix(wide(h))[0]) * seed & (2**64 - 1)
            if (v ^ v >> 29) < 2 ** (64 - int(imatch._HALVINGS[k])):
                inside.append(h)
        total = sum(int(imatch.mix(wide(h + (i + 1) * int(imatch._SEEDS[0])))[0]) for i, h in enumerate(inside))
        slots.append(int(imatch.mix(wide(total))[0]) >> 48 | 1 if inside else 0)
    return "".join(f"{s:04x}" for s in slots)


def test_fingerprints_equal_the_definition(docs):
    texts = [r.text for r in docs.collect()][:14]
    _, _, buf, offs = next(blocks(pa.array(texts)))
    w = Words(buf, offs, lower=True)
    sets = [set(w.hash[a:b].tolist()) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    lexicon = {h for h in set().union(*sets) if h % 3}
    got = imatch.fingerprints(pa.array(texts), np.sort(np.array(list(lexicon), np.uint64)))
    assert got == [plain_print(s, lexicon) for s in sets]


def test_likeness_estimates_the_similarity_of_terms():
    rng = random.Random(12)
    for n, changed in ((200, 0), (200, 20), (200, 50), (1000, 250), (60, 60), (400, 400)):
        found = []
        for t in range(12):
            own = [f"w{t}x{i}" for i in range(n)]
            other = [*own[: n - changed], *(f"v{t}x{i}" for i in range(changed))]
            rng.shuffle(other)
            found.append(imatch.likeness(*imatch.fingerprints(pa.array([" ".join(own), " ".join(other)]), np.zeros(0, np.uint64))))
        assert abs(np.mean(found) - (n - changed) / (n + changed)) < 0.15, (n, changed, found)


def test_imatch_single_document_follows_itself(ready):
    r = imatch.fingerprint(ready.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1


# --- language model --------------------------------------------------------------------------------------------------


def test_language_model(docs):
    model, unigrams = ngram_lm.train(docs, remainder("doc_id", 7) != 2)
    rows = by_row(ngram_lm.score(docs, model, unigrams, ["doc_id", "text"]))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(r.doc_id, [*words_of((r.text or "").translate(low)), None]) for r in docs.collect()]
    c = Counter(w for d, t in tokens if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d, len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for d, t in tokens)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score <= 0 for r in rows)


def test_language_model_probabilities_sum_to_at_most_one():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 12, 4000)
    known = np.arange(100, 112, dtype=np.uint64)
    two = Counter(zip(text, text[1:], strict=False))
    two = {k: n for k, n in two.items() if n > 20}
    k2 = np.array(sorted(int(a) << 32 | int(b) for a, b in two))
    n2 = np.array([two[k >> 32, k & 0xFFFFFFFF] for k in k2])
    at = {int(k): i for i, k in enumerate(k2)}
    three = Counter((at[int(a) << 32 | int(b)], int(c)) for a, b, c in zip(text, text[1:], text[2:], strict=False) if int(a) << 32 | int(b) in at and int(b) << 32 | int(c) in at)
    three = {k: n for k, n in three.items() if n > 3}
    k3 = np.array(sorted(a << 32 | b for a, b in three))
    n3 = np.array([three[k >> 32, k & 0xFFFFFFFF] for k in k3])
    m = ngram_lm.build(known, np.bincount(text, minlength=12), k2, n2, k3, n3, len(text), 12, 1)
    m = ngram_lm.Model.mapped(*m.to_bytes())
    for a in range(12):
        for b in range(12):
            logs = [ngram_lm.log_probabilities(m, np.array([a, b, c]), np.array([0, 3]))[0][2] for c in range(12)]
            assert 0.9 < sum(10.0**x for x in logs) <= 1


def plain_score(texts: list[str | None], learns: list[bool]) -> list[float]:
    """log10 probabilities by the definition, from every 1-, 2- and 3-gram of the training texts."""
    rows = [["<s>", *words_of((t or "").lower()), None] for t in texts]
    c = [Counter(tuple(r[i : i + k]) for r, on in zip(rows, learns, strict=True) if on for i in range(len(r) - k + 1)) for k in (1, 2, 3)]
    n, v = sum(x for k, x in c[0].items() if k != ("<s>",)), len(c[0]) - (("<s>",) in c[0])

    def p(gram: tuple) -> float:
        if len(gram) == 1:
            return (c[0][gram] + 1) / (n + v + 1)
        seen, lower = c[len(gram) - 2][gram[:-1]], p(gram[1:])
        m = math.sqrt(seen) * ngram_lm.MASS
        return (c[len(gram) - 1][gram] + m * lower) / (seen + m) if seen else lower

    return [sum(math.log10(p(tuple(r[max(0, i - 2) : i + 1]))) for i in range(1, len(r))) for r in rows]


def test_language_model_counts_every_gram(ready, monkeypatch):
    """Also those met once among many tokens, over several blocks and ranges of hashes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in (rng.pareto(0.7, rng.integers(0, 60)) * 3).astype(int)) for _ in range(300)]
    texts += [None, "", "Once met phrase", "once met phrase", "once met other", *["copy of a copy"] * 40]
    learns = [zlib.crc32(str(i).encode()) % 3 != 2 for i in range(len(texts))]
    docs = ready.createDataFrame([(i, t, on) for i, (t, on) in enumerate(zip(texts, learns, strict=True))], "doc_id long, text string, on boolean").repartition(5)
    want = plain_score(texts, learns)
    monkeypatch.setattr(ngram_lm, "BLOCK", 4000)
    monkeypatch.setattr(ngram_lm, "RANGE", 9000)
    trained = ngram_lm.train(docs, F.col("on"))
    for flag in (None, F.col("on")):
        got = {r.doc_id: r for r in by_row(ngram_lm.score(docs, *trained, ["doc_id"], learns=flag))}
        assert len(got) == len(texts)
        for i, x in enumerate(want):
            assert x - 2 * ngram_lm.STEP * got[i].n_tokens - 1e-6 <= got[i].score <= x + 1e-6


def test_elias_fano_and_packing_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((1, 0), (5, 3), (1000, 10), (1000, 10**7), (300, 2**40)):
        x = np.sort(rng.integers(0, top + 1, n))
        e = ngram_lm.EliasFano.of(x)
        assert (e.at(np.arange(n)) == x).all()
    for width in (1, 7, 20):
        x = rng.integers(0, 1 << width, 500)
        assert (ngram_lm.unpack(ngram_lm.pack(x, width), width, np.arange(500)) == x).all()


def test_language_model_without_training(docs, empty):
    model, unigrams = ngram_lm.train(docs, F.lit(False))
    rows = by_row(ngram_lm.score(docs, model, unigrams, ["doc_id"]))
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    model, unigrams = ngram_lm.train(empty, F.lit(True))
    assert ngram_lm.score(empty, model, unigrams, ["doc_id"]).count() == 0


# --- language ID -----------------------------------------------------------------------------------------------------


def plain_bits(grams: dict, text: bytes) -> float:
    """The PPM code length by the definition: (context, symbol) counts of orders 0 to 3."""
    x = [0, 0, 0, *(int(langid.CLASSES[b]) for b in text)]

    def p(context: tuple, s: int) -> float:
        seen = grams.get(context, {})
        total, q = sum(seen.values()), len(seen)
        if s in seen:
            return seen[s] / (total + q)
        lower = p(context[1:], s) if context else 1 / langid.SIZE
        return (q / (total + q) if total else 1) * lower

    return -sum(math.log2(p(tuple(x[i - 3 : i]), x[i])) for i in range(3, len(x)))


def test_code_lengths_equal_the_definition():
    train = {"aa": [b"abracadabra banana", b"abba"], "bb": [b"xyzzy plugh", "éé".encode()]}
    keys, names, grams = [], [], {}
    for lang, texts in train.items():
        g = grams.setdefault(lang, defaultdict(Counter))
        for t in texts:
            x = [0, 0, 0, *(int(langid.CLASSES[b]) for b in t)]
            for i in range(3, len(x)):
                for k in range(4):
                    g[tuple(x[i - k : i])][x[i]] += 1
                keys.append(((x[i - 3] * 158 + x[i - 2]) * 158 + x[i - 1]) * 158 + x[i])
                names.append(lang)
    table = pa.table({"lang": names, "gram": pa.array(keys, pa.int64()), "n": np.ones(len(keys), np.int64)}).group_by(["lang", "gram"]).aggregate([("n", "sum")]).rename_columns(["lang", "gram", "n"])
    model = langid.compile_trees(table, 1)
    for text in ("banana abra", "xyz", "été qq", ""):
        _, _, buf, offs = next(blocks(pa.array([text])))
        got = langid.code_lengths(model, buf, offs)[0]
        assert np.allclose(got, [plain_bits(grams[k], text.encode()) for k in model.langs], rtol=1e-5)


def test_language_id(docs, empty):
    model = langid.train(docs, remainder("doc_id", 3) != 1)
    rows = by_row(langid.predict(docs, model, ["doc_id", "text"]))
    assert len(rows) == docs.count()
    for r in rows:
        letter = r.text is not None and any(map(str.isalpha, r.text))
        assert (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    nothing = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in by_row(langid.predict(docs, nothing, ["doc_id"]))} == {"und"}


def test_language_id_held_out_accuracy(ready):
    sf = "/root/testdata/sf0.01"
    lang = ready.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op7_language_id(ready, sf).where("held_out").join(lang, "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


# --- BPE and packing -------------------------------------------------------------------------------------------------


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


ODD = ["It's a.'s we'RE DON'T can't.'ve x.Y", "A<|ENDOFTEXT|>b<|endoftext|>c", "é.b É.x a1b2 3.4 … a…. b", "ΑΣ Σας İI ǅ", "é ́x ﬁ ½ ٣", "a b c", "\x00\x01 \x1cq", "🙂🙂 👩‍👩‍👧 'S 'll", *thue_morse()]


def test_bpe_equals_the_library(ready, docs):
    t = library()
    texts = docs.select("doc_id", "text").union(ready.createDataFrame([(100 + i, x) for i, x in enumerate(ODD)], "doc_id long, text string"))
    rows = by_row(bpe.encode_digests(texts, PATH, ["doc_id", "text"]))
    for r in rows:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), r.text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = by_row(bpe.decode(bpe.encode(texts, PATH, ["doc_id", "text"]), PATH))
    assert all(r.decoded == t.decode(t.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in both)


def test_encoder_forgets_without_harm():
    t, e = library(), bpe.Encoder(PATH, most_rare=5)
    for text in ("one two three four", "five six seven eight nine ten", "one two ten", ""):
        for _, _, buf, offs in blocks(pa.array([text])):
            assert e.encode(bpe.tokenizer_words(buf, offs))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    t = library()
    for capacity in (4096, 16):
        rows = by_row(packing.pack(docs, PATH, capacity=capacity))
        made = defaultdict(list)
        for r in rows:
            made[r.sequence_id].append(r)
        for own in made.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= capacity
        want = Counter()
        total = 0
        for r in docs.collect():
            ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
            total += len(ids)
            for p in range(0, len(ids), capacity):
                part = ids[p : p + capacity]
                want[r.doc_id, p // capacity, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        assert len(made) <= -(-total // capacity) + 2
    assert packing.pack(empty, PATH).count() == 0


def test_plans_are_optimal_on_small_cases():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.randint(5, 12)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]

        def best(left, open_bins, capacity=capacity):
            if not left:
                return len(open_bins)
            n = [best(left[1:], [*open_bins, left[0]])]
            for i, b in enumerate(open_bins):
                if b + left[0] <= capacity and b not in open_bins[:i]:
                    n.append(best(left[1:], [*open_bins[:i], b + left[0], *open_bins[i + 1 :]]))
            return min(n)

        plan = packing.plan_bins(np.bincount(sizes, minlength=capacity + 1), capacity)
        used = Counter()
        for items, m in plan:
            assert sum(items) <= capacity
            for x in items:
                used[x] += m
        assert used == Counter(sizes)
        assert sum(m for _, m in plan) == best(sorted(sizes, reverse=True), [])
