import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflow.llm import chat, langid, suffix_dedup, token_ids, toxicity


# --- chat --------------------------------------------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\/s>", "[\\INST]", "[SEP][SEP]", "[", "<", "/s>", "", "\\\\[INST]\\", "naïve 😀 <s>", "a\nb\\n"]


def test_chats_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[INST]", "a\\"]), "".join(rng.choices(NASTY, k=rng.randint(0, 4)))) for c in range(60) for t in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.conv_id: r for r in chat.parse_chats(chat.write_chats(df)).collect()}
    formatted = {r.conv_id: r for r in chat.format_chats(df).collect()}
    turns = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        turns[c].append((role, text))
    assert set(got) == set(turns)
    for c, want in turns.items():
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert list(got[c].loss_texts) == [t for r, t in want if r == "assistant"]
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert formatted[c].formatted.count("<s>[INST]") == blocks


def test_awkward_chats(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, 5, "assistant", None), (2, None, "assistant", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, _turns string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_chats(chat.write_chats(df)).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "b")], None: [("assistant", "")], 2: [("assistant", "x"), ("assistant", "y"), ("assistant", "y")]}
    assert chat.parse_chats(chat.write_chats(df.limit(0))).count() == 0


# --- language ----------------------------------------------------------------------------------------------------


def test_languages_held_out(documents):
    model = langid.train(documents)
    rows = {r.doc_id: r for r in langid.identify(documents, model).collect()}
    lang = {r.doc_id: r.lang for r in documents.collect()}
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in rows.items() if r.held_out} == set(held)
    assert np.mean([rows[d].lang_pred == lang[d] for d in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def brute_languages(rows):
    """rows: id, text, lang. Counts, frequencies and scores in plain dictionaries; returns a function of a text."""
    import re
    from math import exp, log, log10, sqrt

    split = lambda t: re.findall(r"[^\W\d_]+", t.lower()) or [t.lower()]
    grams = lambda w, k: [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]
    words, parts = defaultdict(Counter), defaultdict(Counter)
    for d, text, lang in rows:
        if d is not None and text is not None and lang is not None and zlib.crc32(str(d).encode()) % 5 and any(c.isalpha() for c in text):
            for w in split(text):
                words[lang][w] += 1
                for k in range(1, 6):
                    parts[lang, k].update(grams(w, k))
    langs = sorted(words)

    def score(counter, key):
        return log10(sum(counter.values()) / counter[key]) if counter[key] else 7.0

    def of_word(w):
        if any(words[x][w] for x in langs):
            return [score(words[x], w) for x in langs]
        for k in range(5, 0, -1):
            own = grams(w, k)
            if any(parts[x, k][g] for x in langs for g in own):
                return [sum(score(parts[x, k], g) if any(parts[y, k][g] for y in langs) else 7.0 for g in own) / len(own) for x in langs]
        return [7.0] * len(langs)

    def predict(text):
        if not text or not langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        rows = [of_word(w) for w in split(text)]
        mean = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        weight = [exp((min(mean) - m) * log(10) * sqrt(len(rows))) for m in mean]
        return langs[mean.index(min(mean))], max(weight) / sum(weight)

    return predict


def test_languages_by_brute_force(spark, documents):
    """Every pair of a language and a word or n-gram is in the model, and every score is as plain counting gives it."""
    few = documents.where("length(text) < 1500 or text is null").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(7001, "½ İstanbul x² ﬁn ß ΑΣ", "tr"), (7002, "İİ ½½", "tr"), (7003, "ªº zz" * 9, None)], few.schema)
    rows = few.union(odd)
    source = [tuple(r) for r in rows.collect()]
    predict = brute_languages(source)
    got = {r.doc_id: r for r in langid.identify(rows, langid.train(rows)).collect()}
    assert len(got) == len(source)
    for d, text, _ in source:
        lang, score = predict(text)
        assert (got[d].lang_pred, got[d].score) == (lang, pytest.approx(score, abs=2e-3)), text


def test_a_larger_model_than_allowed_is_fitted_to_fewer_rows(documents, monkeypatch):
    size = lambda m: len(m["words"].scores) + len(m["grams"].scores)
    whole = size(langid.train(documents))
    monkeypatch.setattr(langid, "MAX_PAIRS", whole // 3)
    assert 0 < size(langid.train(documents)) <= whole // 3


def test_backoff_goes_to_shorter_grams(monkeypatch):
    monkeypatch.setattr(langid, "CACHE", 8)
    table = lambda d: langid.Table.of(*(np.array(c) for c in zip(*[(langid.key_of(w), i, x) for w, xs in d.items() for i, x in enumerate(xs) if x], strict=True)))
    s = langid.Scorer({"langs": ["a", "b"], "words": table({"known": (1.0, None)}), "grams": table({"<xy": (2.0, None), "z": (None, 3.0)})})
    assert s.predict(["known"])[0][0] == "a"
    assert s.backoff(["xyq", "qqz", "qqq"]).argmin(1).tolist() == [0, 1, 0]
    assert s.backoff(["qqq"]).tolist() == [[langid.PENALTY] * 2]
    assert s.predict(["123 !?", None, "", "known " * 40, "a b c d e f"])[:3] == [("und", 0.0)] * 3


def test_awkward_languages(awkward, nothing, documents):
    model = langid.train(documents)
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.identify(nothing, model).count() == 0
    untrained = langid.train(nothing)
    assert {(r.lang_pred, r.score) for r in langid.identify(awkward, untrained).collect()} == {("und", 0.0)}


# --- repeated byte strings ---------------------------------------------------------------------------------------


def brute_repeats(docs):
    """docs: id, text. What is left of each by the definition; null ids come last and are not before one another."""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], (True, 0)), (d is None, d or 0))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (d is None, d or 0):
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def repeats_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect())


def test_repeats_of_documents(documents, texts):
    assert repeats_of(documents) == brute_repeats(texts.items())


def test_repeats_overlap_and_nest(spark, monkeypatch):
    """Passages of 49 to 140 bytes planted at random, periodic texts, and one anchor with many strings."""
    monkeypatch.setattr(suffix_dedup, "BATCH", 16)
    monkeypatch.setattr(suffix_dedup, "HOT", 16)
    rng = random.Random(7)
    letters = lambda n: "".join(rng.choices("abcdé", k=n))
    passages = [letters(n) for n in (42, 50, 60, 90, 130)] + ["ab" * 60, "x" * 100]
    docs = [(i, "".join(rng.choice([letters(rng.randint(0, 30)), rng.choice(passages)]) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert repeats_of(df) == brute_repeats(docs)


def test_anchors_depend_on_the_window_alone(monkeypatch):
    """Around 2^20 and around the pieces of a long text, periodic passages among them."""
    rng = random.Random(3)
    passages = [b"ab" * 40, b"abc" * 30, b"x" * 70, bytes(rng.choices(b"abcdefgh", k=90))]
    for piece in (1 << 19, 1000):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        for edge in (1 << 20, 3000):
            for passage in passages:
                text = bytes(rng.choices(b"abcdefgh ", k=edge - 50)) + passage + bytes(rng.choices(b"abcdefgh ", k=200))
                m, first, count = suffix_dedup.strings_of(text)
                of = np.repeat(m, count)
                assert first.tolist() == np.concatenate(([0], np.cumsum(count)[:-1])).tolist()
                for w in range(edge - 120, edge + 120):
                    assert suffix_dedup.strings_of(text[w : w + 50])[0].tolist() == [of[w]]


def test_repeats_beyond_a_mebibyte(spark):
    """A periodic passage that straddles 2^20 bytes in one document and is short elsewhere."""
    rng = random.Random(4)
    rows = []
    for i in range(3):
        passage = bytes(rng.choices(b"pqrs", k=i + 2)).decode() * 50
        rows += [(2 * i, passage[:50]), (2 * i + 1, "".join(rng.choices("abcdefgh ", k=(1 << 20) - 25)) + passage[:50] + "".join(rng.choices("ijklm", k=40)))]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (50 * (i % 2), i % 2) for i in range(6)}


def test_rows_with_one_id_or_none(spark):
    """Many rows without an id or with the same one, and rows repeated whole."""
    passage = "a passage of more than fifty bytes that very many of the rows share with one another; "
    rows = [(None, passage * (1 + i % 2) + str(i)) for i in range(40)] + [(7, f"{i} " + passage) for i in range(40)] + [(9, passage)] * 20 + [(None, passage)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert repeats_of(df) == brute_repeats(rows)


def test_repeats_of_awkward_rows(awkward, nothing):
    assert repeats_of(awkward) == brute_repeats([(r.doc_id, r.text) for r in awkward.collect()])
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_transform_by_columns():
    """The transform and common prefixes of a collection against sorting all its suffixes."""
    rng = random.Random(2)
    for _ in range(20):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(1, 20))) for _ in range(rng.randint(1, 8))]
        bwt, lcp, _ = suffix_dedup.construct(strings)
        suffixes = sorted((s[i:], s[i - 1 : i]) for s in strings for i in range(len(s) + 1))
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1][0], suffixes[k][0]
            same = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == same
        assert sorted(bwt.tolist()) == sorted(s[0] + 1 if s else 0 for _, s in suffixes)


# --- token ids ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return str(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def brute_tokens(tokenizer, docs):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer), 0, []
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens_of_documents(spark, documents, texts, tokenizer):
    rows = token_ids.read(spark, token_ids.write(documents.repartition(5), tokenizer)).collect()
    assert sorted(map(tuple, rows)) == brute_tokens(tokenizer, sorted(texts.items()))


def test_awkward_tokens(spark, awkward, nothing, tokenizer):
    rows = token_ids.read(spark, token_ids.write(awkward, tokenizer, parts=3)).collect()
    own = brute_tokens(tokenizer, [(r.doc_id, r.text) for r in awkward.collect()])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, n, c) for d, _, n, c in own)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert token_ids.read(spark, token_ids.write(nothing, tokenizer)).count() == 0


def test_words_alone_have_the_ids_of_the_text(tokenizer):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer), random.Random(4)
    pieces = ["it's", "A.", "word,", "x²", "é", "é", "́", "<|endoftext|>", "'LL", "!!", "..", "1.", "ab1,", "Ünï!", " ", "\x1c", "中.", "ß;", "_,", "İ.", "Σ", "ΑΣ,", "it'S."]
    encoder = token_ids.WordEncoder(tokenizer)
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "\t "]) for _ in range(rng.randint(0, 12)))
        assert encoder.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_special_tokens_count_only_as_written(tokenizer):
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(tokenizer), random.Random(5)
    names = ["<|endoftext|>", "<|EndOfText|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "<|EndOf", "<|"]
    texts = ["a <|EndOfText|> b", *("".join(rng.choice([*names, "Word", "A.", "É", ","]) + rng.choice(["", " "]) for _ in range(8)) for _ in range(200)), "Plain Words."]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    encoder = token_ids.WordEncoder(tokenizer)
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [encoder.encode([x])[0].tolist() for x in texts] == want


def test_slices_of_a_batch_are_read_right(tokenizer):
    import pyarrow as pa

    texts = [f"Text {i}, é{'à' * (i % 3)} ends. " * (i % 4) for i in range(60)]
    encoder = token_ids.WordEncoder(tokenizer)
    whole, column = encoder.encode(texts), pa.array(texts)
    for a in range(0, 60, 7):
        assert [x.tolist() for x in encoder.encode(column.slice(a, 7))] == [x.tolist() for x in whole[a : a + 7]]


def test_tokens_are_read_by_place_from_the_files(spark, documents, texts, tokenizer, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_ids, "SEGMENT", 5000)
    monkeypatch.setattr(token_ids.Codes, "all", None)  # nothing is decoded whole
    files = spark.read.schema(token_ids.FILES).parquet(token_ids.write(documents, tokenizer, parts=3))
    t, want, asked = Tokenizer.from_file(tokenizer), Counter(), []
    for d, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        for i in {0, len(ids) // 2, len(ids) - 1}:
            want[d, i, ids[i]] += 1
            asked.append((d, i))
        asked += [(d, -1), (d, len(ids))]
    got = token_ids.tokens_at(files, spark.createDataFrame(asked, "doc_id long, i long")).collect()
    assert files.count() > 3
    assert Counter(map(tuple, got)) == want


def test_other_tokenizers_encode_whole_texts(spark, documents, texts):
    path = str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    assert not token_ids.WordEncoder(path).by_words
    rows = token_ids.read(spark, token_ids.write(documents, path, parts=3)).collect()
    assert sorted(map(tuple, rows)) == brute_tokens(path, sorted(texts.items()))


def test_the_known_file_is_encoded_by_words(tokenizer):
    import json

    config = json.loads(token_ids.read_file(tokenizer))
    assert token_ids.word_by_word(json.dumps(config))
    for key, value in (("normalizer", None), ("pre_tokenizer", None), ("padding", {}), ("added_tokens", [{**config["added_tokens"][0], "content": "end"}])):
        assert not token_ids.word_by_word(json.dumps({**config, key: value}))


def test_codes_give_any_id_without_decoding():
    rng = np.random.default_rng(1)
    for top in (1, 200, 256, 70_000, 1 << 32):
        ids = rng.integers(0, top, 3000).astype(np.uint32)
        codes = token_ids.Codes(token_ids.encode(ids))
        assert codes.all().tolist() == ids.tolist()
        assert [codes[i] for i in (0, 1, 511, 512, 513, 1024, 2999)] == ids[[0, 1, 511, 512, 513, 1024, 2999]].tolist()
    assert token_ids.Codes(token_ids.encode(np.empty(0, np.uint32))).all().tolist() == []


# --- toxicity ----------------------------------------------------------------------------------------------------


def brute_marginals(emission, transition, fresh):
    """By enumeration of all tag sequences of each text."""
    from itertools import product

    starts = [*np.flatnonzero(fresh), len(emission)]
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        total, one = 0.0, np.zeros(b - a)
        for tags in product((0, 1), repeat=b - a):
            w = np.exp(sum(emission[a + i] * t for i, t in enumerate(tags)) + sum(transition[x, y] for x, y in zip(tags, tags[1:], strict=False)))
            total += w
            one += w * np.array(tags)
        out.append(one / total)
    return np.concatenate(out)


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    sizes = [1, 9, 2, 7, 1, 10, 8, 6, 9]
    fresh = np.zeros(sum(sizes), bool)
    fresh[np.cumsum([0, *sizes[:-1]])] = True
    emission, transition = rng.normal(0, 3, len(fresh)), rng.normal(0, 1, (2, 2))
    assert np.allclose(toxicity.marginals(emission, transition, fresh), brute_marginals(emission, transition, fresh))


def test_blocks_of_a_chain_multiply_to_the_whole():
    m = np.random.default_rng(1).random((3000, 2, 2)) + 0.01
    v, want = np.ones(2), []
    for x in m:
        v = v @ x
        v = v / v.sum()
        want.append(v)
    assert np.allclose(toxicity.products(m), want)


@pytest.fixture(scope="module")
def marked(spark):
    """Half of the documents hold an insult; labels say which."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        ws = [rng.choice(["sun", "tree", "walk", "blue", "river", "stone", "bread", "wind"]) + rng.choice(["", "s", "y"]) for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                ws.insert(rng.randint(0, len(ws)), rng.choice(["Grubble", "snark", "MUDHEAD"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_documents_and_offsets(marked):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [d for d in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in rows.items() if r.held_out} == set(held)
    assert np.mean([rows[d].predicted == int(d % 4 == 0) for d in held]) >= 0.97
    text = {r.doc_id: r.text for r in docs.collect()}
    said = {text[d][s.start : s.stop].lower() for d, r in rows.items() for s in r.spans}
    assert said == {"grubble", "snark", "mudhead"}


def test_toxic_units_by_brute_force(spark, marked):
    docs, labels = marked
    rows = [tuple(r) for r in docs.join(labels, "doc_id").selectExpr("text as _text", "toxic > 0 as _y").collect()]
    contexts = {(y, a.lower(), w.lower(), b.lower()) for t, y in rows for ws in [["", *toxicity.WORDS.findall(t), ""]] for a, w, b in zip(ws, ws[1:], ws[2:], strict=False)}
    m = Counter(y for y, *_ in contexts)
    counts = defaultdict(Counter)
    for y, _, w, _ in contexts:
        for unit in [(0, w), *((n, w[:n]) for n in toxicity.STARTS if len(w) >= n)]:
            counts[unit][y] += 1
    counts = {u: c for u, c in counts.items() if c[True] >= toxicity.SUPPORT}
    want, n = set(), m[True] + m[False]
    for u, c in counts.items():
        a, b = c[True], c[False]
        table = [(a, (a + b) * m[True] / n), (b, (a + b) * m[False] / n), (m[True] - a, (n - a - b) * m[True] / n), (m[False] - b, (n - a - b) * m[False] / n)]
        g = sum(2 * o * np.log(o / e) for o, e in table if o)
        if a * m[False] > b * m[True] * toxicity.LIFT and g >= 2 * np.log(len(counts)) + toxicity.G_BEYOND:
            want.add(u)
    got = toxicity.toxic_units(spark.createDataFrame(rows, "_text string, _y boolean"))
    assert got == want and (0, "grubble") in want


def plain_score(text, model):
    """Forward and backward over one text in plain loops."""
    ws = toxicity.WORDS.findall(text or "")
    f = [toxicity.features(w) for w in ws]
    w = model.weights
    e = [sum(w[x] for x in f[i][:4]) + model.bias + (w[f[i - 1][4]] if i else 0) + (w[f[i + 1][5]] if i + 1 < len(f) else 0) for i in range(len(f))]
    up, down = [], [np.ones(2)]
    for i, x in enumerate(e):
        v = np.array([1.0, np.exp(x)]) * (up[-1] @ np.exp(model.transition) if i else 1.0)
        up.append(v / v.sum())
    for x in reversed(e[1:]):
        v = np.exp(model.transition) @ (np.array([1.0, np.exp(x)]) * down[-1])
        down.append(v / v.sum())
    p = np.array([(a * b)[1] / (a * b).sum() for a, b in zip(up, reversed(down), strict=False)])
    total = sum(x for x in p if x >= toxicity.NOISE)
    facts = [1.0, np.log1p(total), max(p), total / len(p)] if len(p) else [1.0, 0, 0, 0]
    return 1 / (1 + np.exp(-float(np.dot(facts, model.curve))))


def test_whole_scores_by_brute_force(documents, texts, spark, sf_dir):
    model = toxicity.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for r in toxicity.score(documents, model).collect():
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], model), abs=1e-6)
        assert r.predicted == int(r.score >= 0.5)


def test_awkward_toxicity(awkward, nothing, marked):
    docs, labels = marked
    model = toxicity.train(docs, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.score(nothing, model).count() == 0
    assert toxicity.train(nothing, labels) is None and toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(awkward, None).collect()} == {0.0}
    odd = labels.union(labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))).union(labels.where("doc_id = 0"))
    assert toxicity.train(docs, odd) is not None
