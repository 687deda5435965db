"""p4, p6, p7 and p8: brute force, exact round trips and held-out accuracy, with nulls, repeats, long texts and empty tables."""

import base64
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import duplicates as D
from quern.llm import encoding as E
from quern.llm import packing as P
from quern.llm import tokens as K
from quern.plans import skew


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{K.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=K.WORDS, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60) | st.text(alphabet="abAB =-_0é日\n\t ", max_size=200))
def test_segment_tree_merges_like_the_public_tokenizer(text):
    import tiktoken

    if not hasattr(test_segment_tree_merges_like_the_public_tokenizer, "enc"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{K.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
        test_segment_tree_merges_like_the_public_tokenizer.enc = tiktoken.Encoding("own", pat_str=K.WORDS, mergeable_ranks=ranks, special_tokens={})
    assert K.encoder("byte_bpe_50k")(text) == test_segment_tree_merges_like_the_public_tokenizer.enc.encode_ordinary(text)


def test_token_ids(spark, public):
    texts = [None, "", " ", "plain words", "<|endoftext|> is text", "=" * 30_000, "x" * 9_999 + "é" * 999, "日本語と русский 👩‍💻", "plain words"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)] + [(None, "no key", "")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in K.token_ids(df, "doc_id", "text", "byte_bpe_50k").collect()}
    assert got == {**{i: public.encode_ordinary(t or "") for i, t in enumerate(texts)}, None: public.encode_ordinary("no key")}
    assert all(public.decode(got[i]) == (t or "") for i, t in enumerate(texts))
    assert K.token_ids(df.limit(0), "doc_id", "text", "byte_bpe_50k").count() == 0
    n = {(r["doc_id"], r["tokenizer"]): r["n_tokens"] for r in K.token_counts(df, "doc_id", "text", ["byte_bpe_50k", "piece_bpe_32k", "word_bpe_49k"]).collect()}
    assert n[0, "byte_bpe_50k"] == n[1, "piece_bpe_32k"] == 0 and n[3, "byte_bpe_50k"] == len(got[3]) and n[3, "word_bpe_49k"] == 2


def _fields(text):
    try:
        pairs = json.loads(text, object_pairs_hook=list) if text.strip().startswith("{") else None
    except ValueError:
        pairs = None
    parts = [f"{k} {v}" for k, v in pairs] if pairs is not None else re.split("[;|]", text)
    words = [tuple(re.findall(r"[^\W_]+", p.lower())) for p in parts]
    return tuple(sorted(w for w in words if w))


@pytest.mark.parametrize("hot_rows", [20_000, 20])
def test_formatting_duplicates(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rng = random.Random(2)
    base = ["A: one two; B: three", "x", "max_rows is 4", '{"A": "one two", "B": "three"}', "a-one  TWO|b three", "b: three; b: three; a", "b: three; a", "", " ;;| ", '{"A": "caf\\u00e9", "A": "x"}', "a café;a x", '{"broken": ', "{}"]
    rows = []
    for i in range(300):
        t = "hot text; of rows" if i % 3 == 0 else rng.choice(base)
        t = rng.choice([t, t.upper() if "\\u" not in t else t, t.replace(" ", "  "), " " + t + " "])
        content, raw = rng.choice([(t, None), (None, "[0.8|2024-01-01] " + t), (" -- ", "[0.5]" + t), (t, "[1] other"), (None, t)])
        rows.append((rng.choice([f"id{i:03d}"] * 9 + [None]), content, raw, "v", 1, 2))
    df = spark.createDataFrame(rows + rows[:30], "id string, content string, raw_text string, value string, row int, kid int")
    sets = {}
    for i, c, r, *_ in rows:
        text = c if c and re.search(r"[^\W_]", c) else re.sub(r"^\s*\[[^\]]*\]", "", r or "")
        if i is not None and (f := _fields(text)):
            sets.setdefault(f, set()).add(i)
    want = {(min(s), i) for s in sets.values() for i in s if i != min(s)}
    got = D.formatting_duplicates(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert D.formatting_duplicates(df.limit(0)).count() == 0
    again = spark.createDataFrame([("k", "b; a; a", None, 2), ("k", "a; a; b", None, 2), ("k", "other", None, 5), ("k", "c", None, None), ("l", "A; a; B", None, 1)], "id string, content string, raw_text string, seq long")
    assert [tuple(r) for r in D.formatting_duplicates(again.where("content <> 'a; a; b'"), order="seq").collect()] == [("k", "l")]
    assert D.field_tuples(again, "id", "content", "raw_text", "seq").where("size(fields) = 5").count() == 1
    one = D.distinct_records(D.field_tuples(df, "id", "content", "raw_text"), "id").collect()
    assert {(r["keep_id"], r["copies"]) for r in one} == {(min(s), len(s)) for s in sets.values()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_sum_of_squares_fills_and_never_overfills(sizes):
    box = P.sum_of_squares(np.array(sizes, dtype=np.int64), 50)
    used = np.bincount(box, weights=sizes) if sizes else np.zeros(0)
    assert (used <= 50).all() and (used > 0).all()
    count, best = np.zeros(51, dtype=int), []
    for s in sizes:  # brute force: the least sum of squares after placing
        moves = [(g, g - s) for g in range(s, 51) if count[g]] + [(None, 50 - s)]
        cost = []
        for g, to in moves:
            after = count.copy()
            if g is not None:
                after[g] -= 1
            if to:
                after[to] += 1
            cost.append(int((after**2).sum()))
        g, to = moves[int(np.argmin(cost))]
        best.append(min(cost))
        if g is not None:
            count[g] -= 1
        if to:
            count[to] += 1
    gaps = np.bincount((50 - used).astype(int), minlength=51)[1:] if sizes else np.zeros(50)
    assert not sizes or int((gaps**2).sum()) == best[-1]


@pytest.mark.parametrize("block", [20_000, 40])
def test_packing_holds_every_token_once(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK_ITEMS", block)
    rng = random.Random(4)
    docs = [(i, rng.choice([None, "", "a b c " * rng.randrange(1, 60), "word " * rng.randrange(1, 400)]), "x", 1) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string, box string, tokens int")
    kinds = spark.createDataFrame([("s", "byte_bpe_50k", 64), ("l", "byte_bpe_50k", 1000), ("none", None, 9), ("zero", "byte_bpe_50k", 0)], "container_kind string, tokenizer string, capacity int")
    enc = K.encoder("byte_bpe_50k")
    size = {i: len(enc(t or "")) for i, t, *_ in docs}
    packed = P.pack_documents(df, kinds)
    rows = packed.collect()
    assert len({(r["container_kind"], r["container_id"]) for r in rows}) == len(rows)
    for kind, cap in (("s", 64), ("l", 1000)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert all(sum(t["tokens"] for t in r["texts"]) == r["used"] <= cap for r in mine)
        spans = {}
        for r in mine:
            for t in r["texts"]:
                spans.setdefault(t["doc_id"], []).append((t["start"], t["start"] + t["tokens"]))
        for i, n in size.items():
            s = sorted(spans.get(i, []))
            assert (s == []) == (n == 0) and (not s or (s[0][0] == 0 and s[-1][1] == n and all(a[1] == b[0] for a, b in zip(s, s[1:])) and (n > cap or len(s) == 1)))
    assert {r["container_kind"] for r in rows} == {"s", "l"}
    assert P.pack_documents(df.limit(0), kinds).count() == 0 and P.pack_documents(df, kinds.limit(0)).count() == 0
    assert P.fill_report(packed).where("unused < 0").count() == 0
    check = P.pack_check(df, kinds)
    assert check.where("not whole or not fits or needless").count() == 0
    assert check.count() == 2 * len([n for n in size.values() if n])


CLEAN = [
    "Die Schlüsselliste läuft über, geprüft für große Einträge – „ähnlich“ wie früher.",
    "Vérifié le correctif : la fenêtre de reprise perd l’entête dès la deuxième tentative, déjà.",
    "La sesión ya no falla después de la migración; atención al índice, mañana cambió el tamaño.",
    "Não apagar a configuração após a atualização: o padrão perdeu a referência, são três erros.",
    "Правило: журнал не менять при второй попытке. Хранилище закрывается раньше срока.",
    "Проверено много раз, причина найдена: индекс теряет записи, исправлено в новой версии.",
    "Quy tắc: không xóa đồ thị mã nguồn trong lúc quét lại, độ tin cậy cao, đã sửa trong bản mới.",
    "原因：调用图丢失最后一行，已在新版本修复。规则：不要修改知识库，其中别名表跳过归档条目。",
    "It’s easier to test “while the café profile is loaded” — see notes ±5 %… √n ≈ 22, π·r², µs ≤ 8 °C",
    "├── lease/\n│   ├── walk.mjs\n└── jobs/ ✓ done 🚀",
]


def _corpus(rng, n):
    words = [c.split(" ") for c in CLEAN]
    return [" ".join(rng.choice(w) if rng.random() < 0.2 else x for x in w) for w in (rng.choice(words) for _ in range(n))]


def test_codecs_restore_what_they_garble():
    for chain in E.CHAINS:
        for text in CLEAN:
            bad = E.garble(text, chain)
            if bad != text and "?" not in bad and E.LOST not in bad and "�" not in bad:
                assert E.restore(bad, chain) in (text, None) or any(w not in ("utf-8",) for w, _ in chain)


def test_garbled_documents_held_out(spark):
    rng = random.Random(6)
    model = E.fit(_corpus(rng, 600))
    seen = {}
    chains = [c for c in E.CHAINS if c in ([("utf-8", "cp1252")], [("utf-8", "latin-1")], [("utf-8", "cp1251")], [("utf-8", "cp437")], [("cp1251", "koi8-r")], [("koi8-r", "cp1251")], [("cp866", "cp1251")], [("utf-8", "cp1252"), ("utf-8", "cp1252")])]
    hits = right = n = 0
    for text in _corpus(rng, 300):
        assert not E.find_garbled(text, model, seen)[0], text
        chain = rng.choice(chains)
        bad = E.garble(text, chain)
        if bad == text or bad.count("?") > text.count("?") or len(E.UNIT.findall(text)) < 4:
            continue
        found, fixed, _, whole = E.find_garbled("A line before.\n" + bad, model, seen)
        n, hits, right = n + 1, hits + found, right + (fixed == "A line before.\n" + text and whole)
    assert n > 100 and hits / n > 0.97 and right / n > 0.85
    rows = [(i, t, "c") for i, t in enumerate(_corpus(rng, 300))] + [(-1, None, ""), (-2, "", ""), (-3, "plain", ""), (500, E.garble(CLEAN[4], [("utf-8", "cp1251")]), ""), (500, E.garble(CLEAN[4], [("utf-8", "cp1251")]), "")]
    out = E.garbled_documents(spark.createDataFrame(rows, "doc_id long, text string, chains string"))
    assert [(r["doc_id"], r["restored"]) for r in out.collect()] == [(500, CLEAN[4])] * 2
    assert E.garbled_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_of_chains_on_held_out_lines(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, t + "\nplain") for i, t in enumerate(_corpus(rng, 400))] + [(None, CLEAN[0]), (900, None), (901, "")], "doc_id long, text string")
    rows = E.held_out_quality(docs).collect()
    names = {E.chain_name(c) for c in E.CHAINS}
    assert {r["chain"] for r in rows} <= names and all(0 <= r["restored"] and 0 <= r["found"] <= r["lines"] for r in rows)
    assert sum(r["lines"] for r in rows) > 30 and sum(r["found"] for r in rows) > 0.8 * sum(r["lines"] for r in rows)
    assert E.held_out_quality(docs.limit(0)).count() == 0
