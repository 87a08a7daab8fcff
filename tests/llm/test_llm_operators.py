import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("latticework.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from latticework.llm import chat, graph_search, hamming_search, language, mixing, near_dedup, packing, repeats, resampling, skew, textkit, token_blocks, tokenkit  # noqa: E402
from latticework.llm.graph import connected_components  # noqa: E402

RND = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "über", "été", "x1"]


def text(n):
    return " ".join(RND.choice(WORDS) + str(RND.randint(0, 99)) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    """Extra columns with names that operators use inside must do no harm."""
    return spark.createDataFrame(rows, schema).withColumn("n", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("score", F.lit(None).cast("string")).withColumn("length", F.lit(2))


def edge_documents():
    base = text(200).split()
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, text(60)), (6, text(4000))]
    for i in range(10, 40):  # near copies, many of them close to the threshold
        copy = list(base)
        for _ in range(i % 7):
            copy[RND.randrange(len(copy))] = f"edit{RND.randint(0, 999)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[6][1]) for i in range(3)] + [(i, text(RND.randint(1, 90))) for i in range(200, 215)]
    return rows + [rows[5]]  # a repeated row


def thue_morse():
    """Two words that collide in every polynomial hash modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return one, one.translate({97: 98, 98: 97})


def shingles(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rows = [*((900 + i, t) for i, t in enumerate(thue_morse())), *edge_documents()]
    out = near_dedup.near_duplicates(table(spark, [*rows, (None, "a b")])).collect()
    want = brute_components(rows)
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_sketch_fills_and_estimates():
    a, b = textkit.stream(400, 40), textkit.stream(500, 40)
    s = near_dedup.sketch([a, b, a[:1]], 128)
    assert (s != np.iinfo(np.uint64).max).all() and abs((s[0] == s[1]).mean() - 0.8) < 0.15


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_frequent_keys_join_alike(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "HOT", 4)
    keys = [1] * 40 + [2] * 20 + list(range(3, 33)) + [None] * 3
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k long")
    sized = [(k, n, f"v{k}") for k, n in Counter(keys).items() if k is not None and k % 5]
    got = skew.join_keyed(rows, spark.createDataFrame(sized, "k long, size long, v string"), ["k"], "size", len(keys), how).collect()
    plain = {k: v for k, _, v in sized}
    want = [(i, k, plain.get(k)) for i, k in enumerate(keys) if k in plain or how == "left"]
    assert sorted((r["id"], r["k"], plain.get(r["k"]) if how == "left_semi" else r["v"]) for r in got) == want
    kept = skew.kept_rows(rows, spark.createDataFrame(sized, "k long, size long, v string"), "k", "size", len(keys), ["id"]).collect()
    assert sorted((r["id"], r["k"]) for r in kept) == [(i, k) for i, k in enumerate(keys) if k in plain]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 60: 50}


def brute_repeats(rows, span):
    count = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        count.update(b[k : k + span] for k in range(len(b) - span + 1))
    out = {}
    for i, b in raw:
        mask = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if count[b[k : k + span]] > 1:
                mask[k : k + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        runs = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i] = (len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd", [1024, 1])
def test_repeats_equal_brute_force(spark, crowd):
    shared = text(60)
    rows = [r for r in edge_documents()[:-1] if r[0] < 40] + [(300 + i, f"{text(9)} {shared} {text(5)}") for i in range(12)] + [(400, "ab" * 700), (401, "é" * 150), (402, "x" * 199), (403, "x" * 200)]
    out = repeats.remove_repeats(table(spark, rows), crowd=crowd).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out} == brute_repeats(rows, 200)
    assert next(r for r in out if r["doc_id"] == 0)["kept_text"] is None
    assert repeats.remove_repeats(table(spark, [])).count() == 0


def test_repeats_of_rows_that_share_an_id(spark, tmp_path):
    """Each row is a document of its own; a text without an id repeats others' bytes as well."""
    a, b, c = text(60), text(70), text(80)
    rows = [(1, a + b), (1, c), (2, f"{text(5)} {a}"), (3, text(90)), (3, c + b), (4, text(50)), (5, None), (5, text(40)), (6, b), (6, b)]
    rows += [(None, rows[5][1]), (None, None), (None, text(60))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = repeats.op7_repeats(spark, str(tmp_path)).collect()
    want = brute_repeats([((k, i), t) for k, (i, t) in enumerate(rows)], 200)
    assert Counter(tuple(r) for r in out) == Counter((i, *w) for (_, i), w in want.items() if i is not None)
    groups = repeats.repeat_groups(table(spark, rows)).filter("doc_id is null").collect()
    assert min(r["start"] for r in groups) == 0 and max(r["start"] + r["length"] for r in groups) == len(rows[5][1].encode())


@pytest.mark.parametrize("crowd", [1024, 1])
def test_groups_have_all_occurrences(spark, crowd):
    """Each group is one string with all its places; groups cover what is removed; long passages come whole."""
    shared, long = text(60), text(900)
    rows = [r for r in edge_documents()[:-1] if r[0] < 18] + [(300 + i, f"{text(9)} {shared} {text(5)}") for i in range(6)] + [(320, f"{text(4)} {long}"), (321, f"{long} {text(30)}"), (322, "ab" * 300)]
    raw = {i: (t or "").encode() for i, t in rows}
    df = table(spark, rows)
    groups = {}
    for r in repeats.repeat_groups(df, crowd=crowd).collect():
        groups.setdefault((r["group_id"], r["length"]), set()).add((r["doc_id"], r["start"]))
    cover = {i: bytearray(len(b)) for i, b in raw.items()}
    for (_, n), places in groups.items():
        (piece,) = {raw[i][a : a + n] for i, a in places}
        assert n >= 200 and len(piece) == n and len(places) > 1
        assert places == {(i, k) for i, b in raw.items() for k in range(len(b) - n + 1) if b[k : k + n] == piece}
        for i, a in places:
            cover[i][a : a + n] = b"\1" * n
    want = brute_repeats(rows, 200)
    assert {i: (len(c), sum(c)) for i, c in cover.items()} == {i: w[:2] for i, w in want.items()}
    passages = {}
    for r in repeats.repeated_passages(df, crowd=crowd).collect():
        passages.setdefault(bytes(r["passage"]), set()).add((r["doc_id"], r["start"], r["length"]))
    # whole but for the chance that a neighbouring byte is the same
    assert any({i for i, _, _ in p} == {320, 321} and min(n for _, _, n in p) >= len(long) for p in passages.values())
    assert all(len({raw[i][a : a + n] for i, a, n in p}) == 1 and len(p) > 1 for p in passages.values())
    assert repeats.repeat_groups(table(spark, [])).count() == 0


def test_long_documents_come_in_parts(monkeypatch):
    import pyarrow as pa

    t = text(3000)
    monkeypatch.setattr(textkit, "CHUNK", 1000)
    got = set()
    for lo, base, data, offsets in repeats._segments(pa.array([t]), 200):
        _, first, count, _, _ = repeats.stretches(data, offsets, 200, 100)
        got.update(int(base + f + k) for f, c in zip(first, count, strict=True) for k in range(c))
    assert got == set(range(len(t.encode()) - 199))


def test_maximal_repeats_keep_all_occurrences():
    parts = [b"1abcdef2", b"3abcdef4", b"5bcd6", b"7bcd8"]
    group, length, string, place = repeats.maximal_repeats(parts, 3)
    found = {}
    for g, n, s, p in zip(group, length, string, place, strict=True):
        found.setdefault((int(g), parts[s][p : p + n]), set()).add(int(s))
    assert {k[1]: v for k, v in found.items()} == {b"abcdef": {0, 1}, b"bcd": {0, 1, 2, 3}}


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = language.op2_language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(out) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    docs = spark.createDataFrame([("xx", "abc abd abe " * 9), ("yy", "qrs qrt qru " * 9), (None, "abc"), ("xx", None)], "lang string, text string")
    known = language.learn(docs)
    out = language.identify(table(spark, [(1, None), (2, ""), (3, "12 !?"), (4, "abd ABC"), (5, "qru"), (6, "ωωω")]), known)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "xx" and got[5][0] == "yy" and got[6] == ("xx", 0.0)
    # a tie goes to the smaller language, and repeated rows stay
    both = language.learn(spark.createDataFrame([("zz", "abc"), ("aa", "abc")], "lang string, text string"))
    assert [r["lang_pred"] for r in language.identify(table(spark, [(1, "abc"), (1, "abc")]), both).collect()] == ["aa", "aa"]
    empty = language.learn(docs.limit(0))
    assert [r["lang_pred"] for r in language.identify(table(spark, [(1, "abc")]), empty).collect()] == ["und"]
    assert language.identify(table(spark, []), known).count() == 0


def brute_grams(t, orders=language.ORDERS):
    """All n-grams with a letter of a text between gaps."""
    gap = max(orders) - 1
    points = [0] * gap + [ord(c) if c.isalpha() else 0 for c in (t or "").lower()] + [0] * gap
    return [tuple(points[i : i + n]) for n in orders for i in range(len(points) - gap) if any(points[i : i + n])]


@pytest.mark.parametrize("part", [1 << 20, 50])
def test_languages_equal_brute_force(spark, part, monkeypatch):
    """Containment, levels, popcounts and their correction from the definition, with more languages than a word holds."""
    monkeypatch.setattr(language, "PART", part)
    levels = (0.0, 0.002, 0.01, 0.05)
    langs = [f"l{i:02d}" for i in range(20)]
    stock = {x: [text(1)[:6] + "abcdefghijklmnopqrst"[i] * 2 for _ in range(12)] for i, x in enumerate(langs)}
    rows = [(x, " ".join(RND.choice(stock[x]) for _ in range(30))) for x in langs for _ in range(3)]
    rows += [("l03", "ßß " + stock["l04"][0]), (None, "zzz"), ("l05", None), ("l05", "")]
    known = language.learn(spark.createDataFrame(rows, "lang string, text string"), levels=levels)
    assert known.langs == tuple(langs) and known.slots.shape[0] > 1
    seen = {x: Counter() for x in langs}
    for x, t in rows:
        if x and t:
            seen[x].update(brute_grams(t))
    asked = [t for _, t in rows] + ["zzz qqq", "12 !", None, stock["l07"][0]]
    n, hits = known.counts(asked)
    lang, score = known.predict(asked)
    for j, t in enumerate(asked):
        own = brute_grams(t)
        assert n[j] == len(own)
        sums = []
        for i, x in enumerate(langs):
            total = sum(seen[x].values())
            for v, least in enumerate(levels):
                true = sum(g in seen[x] and seen[x][g] / total >= least for g in own)
                assert true <= hits[i, v, j] <= true + max(3, 0.1 * len(own))  # false positives only add
            sums.append(sum(max(0, hits[i, v, j] - n[j] * known.wrong[i, v]) / (1 - known.wrong[i, v]) for v in range(4)))
        best = int(np.argmax(sums))
        if own:
            share = min(1, max(0, hits[best, 0, j] - n[j] * known.wrong[best, 0]) / (1 - known.wrong[best, 0]) / n[j])
            assert abs(score[j] - share) < 1e-9 and lang[j] == (langs[best] if share > 0 else known.default)
        else:
            assert (lang[j], score[j]) == ("und", 0)
    assert [x for x, (y, t) in zip(lang, rows, strict=False) if y and t and len(t) > 50] == [y for y, t in rows if y and t and len(t) > 50]


def test_filter_holds_every_gram(spark):
    docs = [("a", text(300)), ("b", text(300))]
    for room in (language.FILTER_BYTES, 1):  # a filter of the least size still holds all
        known = language.learn(spark.createDataFrame(docs, "lang string, text string"), filter_bytes=room)
        for i, (_, t) in enumerate(docs):
            for hashes, some, _ in language.grams([t]):
                assert known.contains(hashes[some], i).all()
    other = textkit.stream(3000, 31)
    assert known.contains(other, 0).mean() < 0.05 and abs(known.contains(other, 0).mean() - known.wrong[0, 0]) < 0.02


def test_chat_round_trip():
    hard = ["", "\\", "\\\\l</turn>\n### a: b", "### ", "\\h## \\l/turn>", "a</turn>\n", "</turn", "é\U0001f600:"]
    turns = [(role, t) for role in ("user", "assistant", "a: b### ") for t in hard]
    made, spans = chat.render(turns)
    assert chat.parse(made) == turns
    assert [chat.unescape(made[a:b]) for a, b in spans] == hard


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", -1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", None, 0.0), (1, 5, 99, "user", "lost parent", 5.0), (2, 1, None, None, "only", None), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0)]
    df = spark.createDataFrame(rows, "tree_id long, node long, parent long, role string, text string, score double")
    out = {(r["tree_id"], r["leaf"]): r for r in chat.format_conversations(df).collect()}
    assert set(out) == {(1, 2), (1, 4), (1, 5), (2, 1)}
    assert [out[1, k]["branch_rank"] for k in (5, 4, 2)] == [1, 2, 3]
    assert chat.parse(out[1, 4]["formatted"]) == [("user", "q"), ("assistant", "good"), ("user", "")]
    assert chat.parse(out[2, 1]["formatted"]) == [("", "only")]
    assert chat.format_conversations(df.limit(0)).count() == 0
    # repeated rows, a null node and columns of names that are used inside change nothing
    more = df.unionByName(df).unionByName(df.limit(1).withColumn("node", F.lit(None).cast("long")))
    more = more.withColumn("leaf", F.lit(7)).withColumn("depth", F.lit("x")).withColumn("turns", F.lit(1)).withColumn("to", F.lit(0))
    again = {(r["tree_id"], r["leaf"]): r for r in chat.format_conversations(more).collect()}
    assert again == out


@pytest.mark.parametrize("collide", [False, True])
def test_tokenizer_pieces_equal_whole_texts(collide, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    bits = ["a", "B", "é", "É", "'", " ", "  ", "\n", "\t", "'s", "12", "!", "\u00a0", "\u3000", "ß", "中", "<|endoftext|>", "don't", "İ", "Σ", "\x85", "\x1c"]
    texts = ["".join(RND.choice(bits) for _ in range(RND.randint(0, 30))) for _ in range(3000)] + ["", None, *thue_morse()]
    if collide:
        monkeypatch.setattr(tokenkit, "_encoders", {})
        hashes = textkit.piece_hashes
        monkeypatch.setattr(textkit, "piece_hashes", lambda *a: hashes(*a) & np.uint64(63))
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        whole = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        got = []
        for _, _, ids, bounds in tokenkit.encoded(pa.array(texts), path, by_word, 7):
            got += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [e.ids + [7] for e in whole]


def test_token_blocks_equal_whole_texts(spark, tmp_path):
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*edge_documents()[:-1], *((900 + i, t) for i, t in enumerate(thue_morse()))]
    folder = str(tmp_path / "corpus")
    token_blocks.write_blocks(table(spark, [*rows, (None, "a b")]), path, folder, block=500)
    got = {r["doc_id"]: r for r in token_blocks.read_blocks(spark, folder, digest=False).collect()}
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_blocks.read_blocks(spark, folder).collect()}
    whole, at = Tokenizer.from_file(path), 0
    for i, t in sorted(rows):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i]["start"] == at and got[i]["n_tokens"] == len(ids) and np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert crc[i] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert len(got) == len(rows)
    # the files are in order, and a part of them can be read
    files = sorted((tmp_path / "corpus/blocks").glob("shard=*/part-*.parquet"), key=lambda f: int(f.parent.name[6:]))
    starts = [s for f in files for s in pq.read_table(f, partitioning=None).column("start").to_pylist()]
    assert len(starts) > 5 and starts == sorted(starts) and len({f.parent for f in files}) == len(files)
    some = token_blocks.read_blocks(spark, folder, digest=False, first_doc=6, last_doc=12).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: got[i]["ids"] for i in got if 6 <= i <= 12}
    twice = str(tmp_path / "twice")
    token_blocks.write_blocks(table(spark, [(1, "a"), (1, "b c d"), (1, "a")]), path, twice)
    assert sorted(r["n_tokens"] for r in token_blocks.read_blocks(spark, twice).collect()) == [2, 2, 4]
    none = str(tmp_path / "none")
    token_blocks.write_blocks(table(spark, []), path, none)
    assert token_blocks.read_blocks(spark, none).count() == 0


def test_damaged_blocks_are_found(spark, tmp_path):
    import public_tokenizers

    token_blocks.write_blocks(table(spark, [(1, "a b c d e f")]), public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/good")
    spark.read.parquet(f"{tmp_path}/good/blocks").withColumn("checksum", F.col("checksum") + 1).write.parquet(f"{tmp_path}/bad/blocks")
    spark.read.parquet(f"{tmp_path}/good/frequencies").write.parquet(f"{tmp_path}/bad/frequencies")
    with pytest.raises(Exception, match="damaged"):
        token_blocks.read_blocks(spark, f"{tmp_path}/bad").collect()


def test_long_texts_are_encoded_in_parts(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenkit, "LONG", 500)
    bits = ["alpha", "Beta", "été", "don't", "12", "x!", "\n\n", "über", "中文", ""]
    texts = [" ".join(RND.choice(bits) for _ in range(2000)), "y" * 3000, "é " * 900]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = public_tokenizers.path(name)
        got = [ids.tolist() for _, _, ids, _ in tokenkit.encoded(pa.array(texts), path, by_word, 7, limit=100)]
        assert got == [e.ids + [7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert len(tokenkit.encoder(path, by_word)._parts(np.frombuffer(texts[0].encode(), np.uint8))) > 5


def test_words_of_long_texts(monkeypatch):
    import pyarrow as pa

    texts = ["".join(RND.choice(["a", "bcdefghijk", "É", "  ", " ", "\t", "\n", "x" * 20]) for _ in range(RND.randint(0, 60))) for _ in range(300)] + ["", None]
    (_, _, data, offsets), = textkit.chunks(pa.array(texts))
    whole = textkit.words(data, offsets, (0, 1))
    sets = textkit.both_sets(data, offsets, 5)
    assert [[len(s) for s in lane] for lane in sets] == [[len(shingles(t)) for t in texts]] * 2
    monkeypatch.setattr(textkit, "CHUNK", 40)
    parts = textkit.words(data, offsets, (0, 1))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_block_checkpoints():
    ids = np.random.default_rng(0).zipf(1.2, 70_000) % 3000
    f, s, y = token_blocks.tables(token_blocks.scaled(np.bincount(ids)))
    block = token_blocks.encode_block(ids, f, s, lanes=16, restart=100)
    assert (token_blocks.decode_block(block, f, s, y)[1] == ids).all()
    for low, high in ((0, 1), (1599, 1601), (3200, 3201), (5, 69_000), (69_999, 70_000), (70_000, 70_000)):
        at, part = token_blocks.decode_block(block, f, s, y, low, high)
        assert at <= low and (part[low - at : high - at] == ids[low:high]).all()
    with pytest.raises(ValueError):
        token_blocks.scaled(np.ones(40), 5)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*edge_documents(), *((900 + i, t) for i, t in enumerate(thue_morse()))]
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(table(spark, [*rows, (None, "a b")]), path, window=256, keep_ids=True).toPandas()
    # no sequence is over the window or has a gap, and few have room left
    sums = out.groupby("sequence_id").length.sum()
    assert (sums <= 256).all() and sums.sum() / 256 / len(sums) > 0.98
    by = out.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out.itertuples())
    # the pieces of a document, in order, are the tokenizer's ids of the whole text
    whole = Tokenizer.from_file(path)
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [1] for i, t in [*rows, (None, "a b")]}
    for i, t in rows:
        part = out[out.doc_id == i].drop_duplicates("start").sort_values("start")
        assert (part.start == part.length.cumsum() - part.length).all() and (part.doc_tokens == len(ids[i])).all()
        assert np.frombuffer(b"".join(part.ids), "<u4").tolist() == ids[i]
    # rows that repeat a doc_id are documents of their own
    assert out.length.sum() == sum(len(ids[i]) for i, _ in [*rows, (None, "")])
    assert packing.pack(table(spark, []), path).count() == 0


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(1)
    hist = Counter((rng.integers(1, 128, 3000) * 16).tolist() + rng.integers(1, 16, 500).tolist() + [2048] * 7)
    used = Counter()
    for combo, m in packing.plan(hist):
        assert sum(combo) <= 2048 and m > 0
        for k in combo:
            used[k] += m
    assert used == hist
    a, b = rng.random((8, 5)), rng.random(8)
    x = packing.nnls(a, b)
    slope = a.T @ (a @ x - b)
    assert (x >= 0).all() and (slope > -1e-7).all() and abs(slope @ x) < 1e-6


def test_searches(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[300:360] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("code", F.lit("x"))
    out = graph_search.nearest(df, "vec_id % 20 = 0", k=5, shard=100).toPandas()
    hits = 0
    for q, part in out.groupby("query_id"):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:5]
        hits += len(set(best) & set(part.vec_id))
        assert np.allclose(part.sort_values("rank").score, score[part.sort_values("rank").vec_id])
    assert len(out) == 100 and hits >= 90
    from latticework.llm.shards import sound_vectors

    got = hamming_search.top_k(hamming_search.sign_codes(sound_vectors(df, "embedding")), "vec_id % 20 = 0", k=5, shard=150).toPandas()
    bits = x > 0
    for q, part in got.groupby("query_id"):
        far = (bits != bits[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(400), far)) if i != q][:5]
        assert part.sort_values("rank").vec_id.tolist() == order
    assert graph_search.nearest(df.limit(0), "vec_id % 20 = 0").count() == 0
    # k is more than there are, a block a query, and vectors of another length
    few = graph_search.nearest(df.filter("vec_id < 8"), "vec_id < 3", k=20, shard=3).toPandas()
    assert Counter(few.query_id) == {0: 7, 1: 7, 2: 7} and all(q not in set(part.vec_id) for q, part in few.groupby("query_id"))
    with pytest.raises(Exception, match="different lengths"):
        graph_search.nearest(df.unionByName(spark.createDataFrame([(7000, [1.0], 1, "x")], df.schema)), "vec_id = 0").collect()
    with pytest.raises(Exception, match="64 components"):
        hamming_search.sign_codes(spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")).collect()
    assert hamming_search.top_k(spark.createDataFrame([], "vec_id long, code long"), "true").count() == 0


@pytest.mark.parametrize("folder", ["sf0.1", "check_s"])
def test_graph_search_recall(spark, folder):
    """The registered query against brute force over its whole table."""
    path = f"/root/testdata/{folder}"
    if not Path(path).exists():
        pytest.skip("no tables here")
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    out = graph_search.op9_graph_search(spark, path).toPandas()
    assert (out.groupby("query_id").size() == 20).all() and set(out.query_id) == {i for i in ids if i % 20 == 0}
    hits = 0
    for q, part in out.groupby("query_id"):
        part = part.sort_values("rank")
        score = x @ x[ids == q][0]
        assert np.allclose(part.score, [score[ids == v][0] for v in part.vec_id])
        assert part["rank"].tolist() == list(range(1, 21)) and [(-s, v) for s, v in zip(part.score, part.vec_id, strict=True)] == sorted((-s, v) for s, v in zip(part.score, part.vec_id, strict=True))
        score[ids == q] = -np.inf
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & set(part.vec_id))
    assert hits / len(out) >= 0.95


def test_build_prunes_and_connects():
    x = np.random.default_rng(3).normal(size=(1500, 8)).astype(np.float32)
    graph, start = graph_search.build(x, degree=12, beam=24)
    assert ((graph >= 0).sum(1) <= 18).all() and (graph < 1500).all() and not (graph == np.arange(1500)[:, None]).any()
    reached, front = {start}, [start]
    while front:
        front = list({int(j) for i in front for j in graph[i] if j >= 0} - reached)
        reached.update(front)
    assert len(reached) > 1490
    # a kept neighbour hides those that it is closer to by alpha
    line = np.array([[0.0], [1.0], [1.1], [-1.0]], np.float32)
    assert graph_search.robust_prune(line, np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.2)[0].tolist() in ([1, 3, -1], [3, 1, -1])


def test_resampling(spark):
    good, bad = [(i, text(40)) for i in range(60)], [(100 + i, "spam !!! spam @@@ buy " * 8) for i in range(20)]
    rows = [*good, *bad, (500, None), (501, "")]
    out = resampling.resample(table(spark, rows), spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long"), 0.75).collect()
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert len(out) == 82 and len(kept) == 61 and not any(100 <= i < 200 for i in kept)
    scored = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "doc_id long, key double")
    got = sorted(r["doc_id"] for r in resampling.top_k(scored, 13).collect() if r["kept"])
    assert got == sorted(sorted(range(50), key=lambda i: (-(i % 5), i))[:13])
    ids = spark.createDataFrame([(i % 900,) for i in range(1000)] + [(None,)], "doc_id long")
    some = [r["doc_id"] for r in resampling.fitted_targets(ids, 100).collect()]
    assert len(set(some)) == len(some) == 100 and min(some) >= 0 and max(some) < 900
    assert resampling.fitted_targets(ids, 900).count() == 900
    none = resampling.resample(table(spark, rows), spark.createDataFrame([], "doc_id long"), 0.5).collect()
    assert sum(r["kept"] for r in none) == 41
    assert resampling.resample(table(spark, []), spark.createDataFrame([(1,)], "doc_id long"), 0.5).count() == 0


def test_resampling_equals_brute_force(spark):
    """Weights from the definition: counts of hashed words and pairs, ratio of two smoothed models, sum over a text."""
    rows = [(i, text(RND.randint(1, 60))) for i in range(80)] + [(500, None), (501, ""), (502, "one")]
    aims = set(range(0, 80, 3))
    buckets, smooth, seed = 512, 0.5, 7

    def cells(t):
        w = [x for x in (t or "").split(" ") if x]
        raw = [np.frombuffer(x.encode(), np.uint8) for x in w]
        h = [int(textkit.piece_hashes(r, np.array([0]), np.array([len(r)]))[0, 0]) for r in raw]
        pairs = [int(textkit.mix(np.array([(a * int(textkit.BASE) + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % buckets for x in h + pairs]

    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        for c in cells(t):
            raw[c] += 1
            target[c] += i in aims
    prior = raw / raw.sum()
    p = (target + smooth * prior * buckets / 1024 + smooth) / (target.sum() + smooth * buckets / 1024 + smooth * buckets)
    q = (raw + smooth) / (raw.sum() + smooth * buckets)
    ratio = np.where(raw > 0, np.log(p / q), 0.0)
    want = {i: sum(ratio[c] for c in cells(t)) for i, t in rows}
    ids = spark.createDataFrame([(i,) for i in aims], "doc_id long")
    out = {r["doc_id"]: r for r in resampling.resample(table(spark, rows), ids, 0.4, buckets=buckets, seed=seed).collect()}
    tempered = {r["doc_id"]: r["log_weight"] for r in resampling.resample(table(spark, rows), ids, 0.4, buckets=buckets, seed=seed, temper=10.0).collect()}
    noise = {}
    for i, t in rows:
        assert abs(out[i]["log_weight"] - want[i]) < 1e-9
        assert abs(tempered[i] - 10 * want[i] / max(1, len(cells(t)))) < 1e-9
        u = int(textkit.mix(np.array([i], np.uint64) ^ textkit.stream(seed, 9)[-1])[0]) // 2**11 / 2**53
        noise[i] = want[i] - np.log(-np.log(u))
        assert abs(out[i]["key"] - noise[i]) < 1e-9
    best = sorted(noise, key=lambda i: -noise[i])[: int(0.4 * len(rows))]
    assert {i for i in out if out[i]["kept"]} == set(best)


def test_mixing(spark):
    rows = [(i, "x" * (50 + i % 900), "a" if i % 3 else "b", ["en", "fr", None][i % 4 % 3]) for i in range(600)] + [(None, None, None, None)]
    df = table(spark, rows, "doc_id long, text string, source string, lang string")
    cells = spark.createDataFrame([("a", "p", 30), ("a", "q", 10), ("b", "p", 5), ("b", "q", 55)], "s string, l string, tokens long")
    aims = {"s": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "s string, share double"), "l": spark.createDataFrame([("p", 0.3), ("q", 0.7)], "l string, share double")}
    raked = mixing.rake(cells, ("s", "l"), aims, 40)[0].toPandas()
    assert np.allclose(raked.groupby("s").weight.sum(), [50, 50], atol=1e-4) and np.allclose(raked.groupby("l").weight.sum(), [30, 70])
    how = mixing.document_margins(df)
    out = mixing.calibrated(df, **how, strict=False).collect()
    assert len(out) == 601 and all(0 <= r["mix_probability"] <= 1 for r in out) and set(out[0].asDict()) >= {"n", "rank", "length"}
    assert all(r["mix_kept"] for r in out if r["mix_probability"] >= 1)
    assert mixing.calibrated(df.limit(0), **how).count() == 0


def test_raking_and_components_take_one_plan_a_round(spark):
    """The driver's memory grows with the plans it makes."""

    def number():
        spark.range(1).count()  # an execution of its own, so that there is a last one
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    cells = spark.createDataFrame([("a", "p", "x", 30), ("a", "q", "y", 10), ("b", "p", "y", 5), ("b", "q", "x", 55)], "s string, l string, t string, tokens long")
    aims = {m: mixing.tempered(cells, m, 0.5) for m in ("s", "l", "t")}
    at = [number()]
    for rounds in (1, 4):
        mixing.rake(cells, ("s", "l", "t"), aims, rounds, 0.0)
        at.append(number())
    assert (at[2] - at[1]) - (at[1] - at[0]) == 3
    connected_components(spark.createDataFrame([(1, 2)], "a long, b long"))
    assert number() - at[2] - 1 == 2


def test_mixing_meets_targets(spark):
    """By rows and columns that a plain fitting in numpy gives, the sample has the targets at the largest fraction."""
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 5}", lang, topic, int(1000 * big * rng.uniform(0.1, 2))) for i in range(5) for lang, big in (("en", 9), ("fr", 3), ("de", 2)) for topic in ("p", "q")]
    docs = spark.createDataFrame([(k, *r[:3], r[3] // 10 + (j < r[3] % 10)) for k, (j, r) in enumerate((j, r) for r in rows for j in range(10))], "doc_id long, source string, lang string, topic string, n_tokens long")
    how = mixing.document_margins(docs)
    got = mixing.calibrated(docs, **how, fraction=0.5).toPandas()
    t = np.array([r[3] for r in rows], float).reshape(5, 3, 2)
    w, total = t.copy(), t.sum()
    aims = [np.sqrt(t.sum(x)) / np.sqrt(t.sum(x)).sum() for x in ((1, 2), (0, 2), (0, 1))]
    for _ in range(200):
        for axis, aim in enumerate(aims):
            w *= np.expand_dims(aim * total / w.sum(tuple({0, 1, 2} - {axis})), tuple({0, 1, 2} - {axis}))
    part = min(0.5, (t / w).min())
    want = {(r[0], r[1], r[2]): p for r, p in zip(rows, (part * w / t).reshape(-1), strict=True)}
    assert np.allclose(got.mix_probability, [want[x] for x in zip(got.source, got.lang, got.topic, strict=True)], atol=1e-6)
    kept = got.n_tokens * got.mix_probability
    assert got.mix_probability.max() <= 1 and abs(kept.sum() / total - part) < 1e-6
    for m, aim in zip(("source", "lang", "topic"), aims, strict=True):
        names = sorted({r[("source", "lang", "topic").index(m)] for r in rows}) if m != "lang" else ["en", "fr", "de"]
        assert np.allclose((kept.groupby(got[m]).sum() / kept.sum())[names], aim, atol=1e-6)
    told = mixing.margins_reached(docs, **how, fraction=0.5).toPandas()
    assert len(told) == 10 and told.feasible.all() and np.allclose(told.reached, told.target, atol=1e-6)
    # an own target lowers the fraction; below ``least`` the value is kept whole and the miss is an error or told
    aims = {"lang": spark.createDataFrame([("de", 0.8), ("fr", 0.1), ("en", 0.1)], "lang string, share double")}
    got = mixing.calibrated(docs, **how, targets=aims).toPandas()
    kept = (got.n_tokens * got.mix_probability).groupby(got.lang).sum()
    assert np.allclose((kept / kept.sum())[["de", "fr", "en"]], [0.8, 0.1, 0.1], atol=1e-6)
    with pytest.raises(mixing.InfeasibleTargets):
        mixing.calibrated(docs, **how, targets=aims, least=0.9)
    told = mixing.margins_reached(docs, **how, targets=aims, least=0.9).toPandas()
    assert not told[told.margin == "lang"].feasible.all()
    # values that exclude each other
    apart = spark.createDataFrame([(1, "a", "en", "p", 10), (2, "b", "fr", "p", 10)], docs.schema)
    aims = {"lang": spark.createDataFrame([("en", 0.9), ("fr", 0.1)], "lang string, share double"), "source": spark.createDataFrame([("a", 0.1), ("b", 0.9)], "source string, share double")}
    with pytest.raises(mixing.InfeasibleTargets):
        mixing.calibrated(apart, **how, targets=aims)


def pipeline_documents():
    """Two languages of their own letters, junk, copies near and exact, passages that several documents share."""
    stock = {"aa": ["".join(RND.choice("bcdefg") for _ in range(5)) for _ in range(300)], "bb": ["".join(RND.choice("rstuvw") for _ in range(5)) for _ in range(300)]}
    said = lambda lang, n: " ".join(RND.choice(stock[lang]) for _ in range(n))
    shared = said("aa", 60)
    rows = [(i, said(lang, RND.randint(20, 300)), lang, f"s{i % 3}") for i in range(40) for lang in (["aa", "aa", "bb"][i % 3],)]
    base = said("aa", 150)
    rows += [(100 + i, " ".join([*base.split()[: 149 - i], "bbb"]), "aa", "s0") for i in range(6)] + [(110, base, "aa", "s1"), (111, base, None, "s2")]
    rows += [(120 + i, f"{said('aa', 30)} {shared} {said('aa', 10)}", "aa", "s1") for i in range(4)]
    rows += [(130, None, "aa", "s0"), (131, "", "aa", "s0"), (132, "12 34 !?", "bb", "s0"), (133, "жжж ззз иии " * 20, None, "s1"), (134, said("bb", 90), "aa", None)]
    return [(i, t, x, s, len(t or "")) for i, t, x, s in rows]


def test_pipeline_equals_brute_force(spark):
    """Every stage against a plain version of it, on what the stage before returned."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = pipeline_documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs, seen = spark.createDataFrame(rows, schema), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        seen[name] = docs.collect()
    # language: letters tell it; junk and unknown letters go
    text_of = {r[0]: r[1] for r in rows}
    kept = {i: t for i, t in text_of.items() if t and any(c in "bcdefgrstuvw" for c in t)}
    assert {r["doc_id"]: r["lang"] for r in seen["language_id"]} == {i: "aa" if t[0] in "bcdefg" else "bb" for i, t in kept.items()}
    # near duplicates: the least of each component
    parts = brute_components(list(kept.items()))
    heads = {i for i, (_, c) in parts.items() if i == c}
    assert {r["doc_id"] for r in seen["near_duplicates"]} == heads and len(heads) < len(kept)
    # repeated passages: the bytes left
    left = [(i, kept[i]) for i in sorted(heads)]
    want = brute_repeats(left, 200)
    got = {r["doc_id"]: r for r in seen["repeated_passages"]}
    for i, t in left:
        size, gone, _, sha = want[i]
        if gone < size:
            assert hashlib.sha256(got[i]["text"].encode()).hexdigest() == sha and got[i]["n_chars"] == len(got[i]["text"] if gone else t)
    assert any(want[i][1] for i in heads) and set(got) <= heads
    # mixing: plain fitting over cells, the largest fraction, the hash of each id
    cells = {}
    tokens = {i: (len(r["text"]) + 3) // 4 for i, r in got.items()}

    def cell(r):
        topic = "short" if len(r["text"]) < 800 else "lines" if 200 * r["text"].count("\n") > len(r["text"]) else "prose"
        return (r["source"] or "(none)", r["lang"], topic)

    for i, r in got.items():
        cells[cell(r)] = cells.get(cell(r), 0) + tokens[i]
    weight, total = dict(cells), sum(cells.values())
    for _ in range(mixing.ROUNDS):
        before = dict(weight)
        for axis in range(3):
            sums = Counter()
            for c, n in cells.items():
                sums[c[axis]] += n
            powers = {v: n**corpus_pipeline.MIX_EXPONENT for v, n in sums.items()}
            now = Counter()
            for c, w in weight.items():
                now[c[axis]] += w
            weight = {c: w * powers[c[axis]] / sum(powers.values()) * total / now[c[axis]] for c, w in weight.items()}
        if max(abs(weight[c] / before[c] - 1) for c in weight) < 1e-9:
            break
    part = min(1.0, 1 / max(weight[c] / cells[c] for c in cells))
    drawn = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) / 2**52 for i in got}
    chance = {i: min(1.0, part * weight[cell(r)] / cells[cell(r)]) for i, r in got.items()}
    mixed = {r["doc_id"]: r["text"] for r in seen["source_mixing"]}
    assert all((i in mixed) == (drawn[i] < chance[i]) for i in got if abs(drawn[i] - chance[i]) > 1e-5)
    # packing: the pieces of each document are its ids
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in seen["sequence_packing"]:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(mixed)
    for i, t in mixed.items():
        ids, at = whole.encode(t, add_special_tokens=False).ids + [1], 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)


def test_pipeline_takes_an_empty_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_pipeline_carries_null_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    twice = text(80)
    rows = [(1, twice, "xx", "s", 1), (2, text(80), "xx", "s", 1), (None, twice, "xx", "s", 7), (None, None, "xx", "s", None), (None, twice, "xx", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        assert Counter(tuple(r) for r in stage(spark, docs, "").collect()) == Counter(rows)


def test_chat_null_trees(spark, tmp_path):
    rows = [(None, 1, None, "user", "q", 0.0), (None, 2, 1, "assistant", "bad", -1.0), (None, 3, 1, "assistant", "good", 2.0), (None, 4, 3, "user", "so", 0.0), (1, 1, None, "user", "other", 0.0)]
    out = {(r["tree_id"], r["leaf"]): r for r in chat.format_conversations(spark.createDataFrame(rows, "tree_id long, node long, parent long, role string, text string, score double")).collect()}
    assert set(out) == {(None, 2), (None, 4), (1, 1)}
    assert chat.parse(out[None, 4]["formatted"]) == [("user", "q"), ("assistant", "good"), ("user", "so")]
    duckdb = pytest.importorskip("duckdb")
    said = [(None, 0, "user", "q"), (None, 1, "assistant", "a: ### "), (None, 2, "user", None), (3, 0, "user", "x"), (3, 1, "assistant", "</turn>")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op3_chat_format(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        want = con.sql(chat.ORACLES["op3_chat_format"])
        assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
