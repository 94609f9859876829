"""Decontamination, alignment and ranked search against brute-force versions of their contracts."""

import hashlib
import random
import re

import pytest

from tessera.llm.op11_decontaminate import decontaminate

DOCS = "doc_id long, text string, items string, n_words int"
ITEMS = "item_id long, text string, print long"


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if m else ():
            windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for m in {len(g) for g in windows}:
            for k in range(len(w) - m + 1):
                own = windows.get(tuple(w[k : k + m]))
                if own:
                    hit |= set(range(k, k + m))
                    names |= {str(n) for n in own if n is not None}
        out.append((doc, len(w), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


def leak_case(seed):
    r = random.Random(seed)
    word = lambda: r.choice(("a", "b", "c", "Über", "d9", "ñ", "the"))
    text = lambda n: "".join(word() + r.choice((" ", "  ", "\n", ", ", "-")) for _ in range(n))
    items = [(i, text(r.choice((1, 2, 4, 7, 9, 10, 11, 25, 60)) if i % 3 else 30)) for i in range(20)]
    items += [(3, text(14)), (None, text(12)), (50, None), (51, ""), (52, "?!"), (10, text(12)), (2, "the " * 30)]
    docs = [(i, text(r.randint(1, 80))) for i in range(25)]
    for i, (_, t) in enumerate(items):
        docs.append((100 + i, text(15) + (t or "") + " " + text(9)))
        docs.append((200 + i, text(5) + " ".join((t or "").upper().split()[: r.randint(5, 14)]) + " zz"))
    docs += [(307, None), (308, ""), (309, " ?! "), (None, items[0][1]), docs[3], docs[30], docs[30], (310, "the " * 200), (311, "x" * 5000 + " " + items[9][1])]
    return docs, items


@pytest.mark.parametrize("most", [10_000_000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_hits_as_by_brute_force(spark, most, seed):
    docs, items = leak_case(seed)
    table = spark.createDataFrame([(d, t, "other", 3) for d, t in docs], DOCS).repartition(5)
    found = decontaminate(table, spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), most=most).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], ",".join(x["items"])) for x in found), key=str) == brute_hits(docs, items)
    text = dict(docs)
    for x in found:
        if x["doc_id"] is not None and text[x["doc_id"]]:
            assert sum(len(plain_words(text[x["doc_id"]][s["start"] : s["end"]])) for s in x["spans"]) == x["n_hit"]


@pytest.mark.parametrize("most", [10_000_000, 0])
def test_no_documents_or_items(spark, most):
    docs, items = leak_case(1)
    table, none = spark.createDataFrame([(d, t, "o", 3) for d, t in docs], DOCS), spark.createDataFrame([], ITEMS)
    assert all(x["n_hit"] == 0 and x["items"] == [] and x["spans"] == [] for x in decontaminate(table, none, most=most).collect())
    assert decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame([(i, t, 1) for i, t in items], ITEMS), most=most).count() == 0


def test_one_very_long_text_is_searched_whole(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "filler text " * 200_000 + passage + " end" * 100_000, "o", 1)], DOCS)
    found = decontaminate(docs, spark.createDataFrame([(5, passage, 1)], ITEMS)).first()
    assert (found["n_words"], found["n_hit"], found["items"]) == (500_040, 40, ["5"])


def brute_alignment(docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    rows, holders = [], {}
    for number, (doc, text) in enumerate(docs):
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        own = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        its = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if not text or b"".join(own) != (" " + text).encode() or b"".join(its) != (" " + text).encode():
            rows.append((doc, 0, 0, 0, [], None))
            continue
        ends = [{sum(map(len, z[: i + 1])) for i in range(len(z))} for z in (own, its)]
        groups, p, q, at, bt = [], [], [], 0, 0
        i = j = 0
        for end in sorted(ends[0] & ends[1]):
            p, q = [], []
            while at < end:
                p.append(x[i])
                at += len(own[i])
                i += 1
            while bt < end:
                q.append(y[j])
                bt += len(its[j])
                j += 1
            groups.append((p, q))
        links = [(s, t) for p, q in groups for s in p for t in q]
        for link in set(links):
            holders.setdefault(link, set()).add(number)
        rows.append((doc, len(x), len(y), len(groups), links, ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)))
    best = {}
    for (s, _), who in holders.items():
        best[s] = max(best.get(s, 0), len(who))
    out = []
    for doc, n_a, n_b, n_groups, links, spelled in rows:
        n = [len(holders[link]) for link in links]
        out.append((doc, n_a, n_b, n_groups, len(links), sum(best[s] == k for (s, _), k in zip(links, n)), sum(n), "" if spelled is None else hashlib.sha256(spelled.encode()).hexdigest()))
    return sorted(out, key=str)


def alignment_texts(texts):
    r = random.Random(4)
    odd = ["a  b", " lead", "trail ", "x \n y", "\n z", "<|endoftext|> <s> </s> <0x41>", "a▁b", "汉字 😀 é", "\x00 nul", "tab\t next", "naïve façade déjà", "don't we'll I'm", "3.14159 2,718", "　wide 　x", "\x85 y", "q \x1c w", "x" * 3000]
    signs = " \n\tab.c1é😀▁<>|　'"
    return [t for t in texts if t is None or len(t) < 20_000] + odd + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(60)]


@pytest.mark.parametrize("most", [10_000_000, 0])
def test_alignment_as_by_the_libraries(spark, texts, most):
    import public_tokenizers

    from tessera.llm.op12_align import align_documents

    docs = [(None if i == 3 else i, t) for i, t in enumerate(alignment_texts(texts))]
    docs.append(docs[7])
    table = spark.createDataFrame([(d, t, "o", 1) for d, t in docs], "doc_id long, text string, pair string, n int").repartition(5)
    found = align_documents(table, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), most=most, with_groups=True).collect()
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(x[c] for c in names) for x in found), key=str) == brute_alignment(docs)
    assert all(x["groups"] == "" or hashlib.sha256(x["groups"].encode()).hexdigest() == x["groups_sha256"] for x in found)
    none = align_documents(table.where("false"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), most=most)
    assert none.count() == 0


def test_common_ends_of_ordered_lists():
    import numpy as np

    from tessera.llm.op12_align import common_ends

    r = random.Random(2)
    texts = [[sorted(r.sample(range(1, 120), r.randint(0, n))) for n in (r.choice((3, 60)), 60)] for _ in range(300)]
    wanted, n_a, n_b = [], 0, 0
    for a, b in texts:
        wanted += [(n_a + a.index(x), n_b + b.index(x)) for x in a if x in b]
        n_a, n_b = n_a + len(a), n_b + len(b)
    first = lambda k: np.concatenate([[0], np.cumsum([len(t[k]) for t in texts])])
    a, b = (np.array([x + 1000 * i for i, t in enumerate(texts) for x in t[k]]) for k in (0, 1))
    assert list(zip(*(x.tolist() for x in common_ends(a, b, first(0), first(1))))) == wanted


def brute_ranks(docs, items, k):
    import math
    from collections import Counter

    terms = [re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    n, total, df = sum(1 for t in terms if t), sum(map(len, terms)), Counter(w for t in terms for w in set(t))
    out = []
    for item, text in items:
        found = []
        for (doc, _), own in zip(docs, terms):
            tf, score = Counter(own), 0
            for w in re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                if tf[w]:
                    m = 100 - 75 + (75 * len(own) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ranks_as_by_brute_force(spark, small, monkeypatch):
    from tessera.llm import op13_ranked

    if small:
        for name, value in (("PART_TERMS", 40), ("MOST_ASKED", 0), ("ROWS", 5), ("SPARSE", 1)):
            monkeypatch.setattr(op13_ranked, name, value)
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "ñ", "the", "The", "汉"]
    text = lambda n: " ".join(r.choice(vocabulary[: r.choice((8, 65))]) for _ in range(n))
    docs = [(i, text(r.choice((1, 3, 20, 60, 300)))) for i in range(120)]
    docs += [(200 + i, docs[4][1]) for i in range(25)] + [(None, docs[4][1]), (None, text(20)), docs[5], docs[5], docs[7], (300, None), (301, ""), (302, " ?! "), (303, "the " * 4000)]
    items = [(i, text(r.choice((1, 5, 30)))) for i in range(12)] + [(3, text(4)), (None, text(6)), (50, None), (51, ""), (52, "?!"), (53, "unseen"), (54, docs[4][1]), (54, docs[4][1]), (55, "the the the")]
    table = spark.createDataFrame([(d, t, 1, "o") for d, t in docs], "doc_id long, text string, bound int, item string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = op13_ranked.search(table, asked, 10).collect()
    assert sorted(((x["item_id"], x["rank"], x["doc_id"], x["score"]) for x in found), key=str) == brute_ranks(docs, items, 10)
    assert op13_ranked.search(table.where("false"), asked).count() == 0
    assert op13_ranked.search(table, asked.where("false")).count() == 0


def test_bounds_are_never_below_scores():
    import numpy as np

    from tessera.llm.op13_ranked import Query, counted, level_keys, matrix

    r = np.random.default_rng(3)
    terms = np.unique(r.integers(1, 1 << 62, 300, dtype=np.uint64))
    texts = [r.choice(terms, int(n)) for n in r.integers(1, 500, 40)]
    hashes, first = np.concatenate(texts), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    df = {int(t): sum(t in x for x in texts) for t in terms}
    asked = [np.unique(r.choice(terms, 20)) for _ in range(15)]
    query = Query(np.repeat(np.arange(15), [len(x) for x in asked]), np.concatenate(asked), np.ones(sum(map(len, asked)), np.int64), df, 40, len(hashes))
    text, term, tf = counted(hashes, first)
    keys = [np.concatenate([level_keys(term[(text == i) & (tf >= 1 << n)], n) for n in range(8)]) for i in range(40)]
    size, bits = matrix(np.concatenate(keys), np.array([len(x) for x in keys]))
    bounds, scores = query.bounds(size, bits, np.diff(first)), query.scores(hashes, first).T
    assert (bounds >= scores).all() and bounds.sum() < 2 * scores.sum()
