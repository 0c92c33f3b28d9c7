"""Operator 2 against a plain restatement: chunks by hand, first owner by document id."""

import random

import numpy as np
import pyarrow as pa

from sealtable.llm import substrings as sub


def plain_chunks(text):
    """Ends of the chunks of one text, byte by byte."""
    data, h, cuts, last = text.encode(), 0, [], 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(sub._GEAR[b])) & 0xFF
        blank = b in b" \t\n\v\f\r"
        last = i if blank else last
        more = i + 1 < len(data)
        inside = i - last >= sub.NO_BLANK and h < sub.CUT_BELOW_INSIDE and more and (data[i + 1] & 0xC0) != 0x80
        if i >= sub.WINDOW - 1 and (blank and h < sub.CUT_BELOW or inside) or not more:
            cuts.append(i + 1)
    return cuts


def plain(rows, min_words):
    """Texts without the repeated runs, in plain Python."""
    owner = {}
    parts = {}
    for doc_id, text in rows:
        data, cuts = (text or "").encode(), plain_chunks(text or "")
        pieces = [data[a:b] for a, b in zip([0, *cuts], cuts)]
        parts[doc_id] = pieces
        for p in pieces:
            owner[p] = min(owner.get(p, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        kept, run = b"", []
        for p in [*parts[doc_id], None]:
            if p is not None and owner[p] < doc_id:
                run.append(p)
                continue
            if len(b"".join(run).split()) < min_words:
                kept += b"".join(run)
            run = []
            kept += p or b""
        out[doc_id] = kept.decode() if text is not None else None
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeäß漢") for _ in range(rng.randrange(1, 9))) for _ in range(400)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    passages = [prose(rng.randrange(51, 90)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = prose(rng.randrange(0, 200))
        if i % 3 == 0:
            text += " " + rng.choice(passages) + " " + prose(30)
        rows.append((i, text))
    return rows + [(100, None), (101, ""), (102, "x" * 3000), (103, "x" * 3000), (104, "same line\n" * 60)], passages


def test_chunks_of_joined_texts():
    texts = [t or "" for _, t in corpus()[0]]
    for first, last, data, cuts, row in sub._chunked(pa.array(texts)):
        for k, text in enumerate(texts[first:last]):
            start = sum(len(t.encode()) for t in texts[first : first + k])
            assert (cuts[row == k] - start).tolist() == plain_chunks(text)


def test_insertions_move_few_chunks():
    text = corpus()[1][0] * 5
    a = set(np.diff([0, *plain_chunks(text)]).tolist())
    pieces = lambda t: {t.encode()[a:b] for a, b in zip([0, *plain_chunks(t)], plain_chunks(t))}
    assert a and len(pieces(text) - pieces("some words more " + text)) <= 2


def test_passages_are_kept_once(spark):
    rows, passages = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, repeats string")
    got = {r.doc_id: r for r in sub.without_repeats(docs.repartition(5)).collect()}
    want = plain(rows, sub.MIN_WORDS)
    assert {i: r.text for i, r in got.items()} == want
    for p in passages:
        holders = [i for i, t in rows if t and p in t]
        assert [i for i in holders if p in got[i].text] == holders[:1]
    for i, text in rows:
        spans, kept, at = got[i].removed, "", 0
        for a, b in zip(spans[::2], spans[1::2]):
            kept, at = kept + text[at:a], b
        assert not spans or kept + text[at:] == got[i].text
    assert got[1].text == rows[1][1] and (got[1].digest, got[1].repeats) == ("x", "y")


def test_hot_passage_and_edge_rows(spark):
    passage = corpus()[1][0]
    rows = [(i, f"{i} start {passage} end {i}") for i in range(200)] + [(None, passage), (7, f"7 start {passage} end 7")]
    got = sub.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    # Document 0 keeps it; a row without id is neither changed nor a source.
    assert sorted((r.doc_id is None, r.doc_id) for r in got if passage in r.text) == [(False, 0), (True, None)]
    assert sub.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def searched(rows):
    """Words of each text that lie in no 50 words in a row of a text of smaller id, by search."""
    texts = {i: " " + " ".join((t or "").split()) + " " for i, t in rows}
    out = {}
    for i, text in rows:
        w = (text or "").split()
        gone = set()
        for k in range(len(w) - 49):
            run = " " + " ".join(w[k : k + 50]) + " "
            if any(j < i and run in texts[j] for j in texts):
                gone |= set(range(k, k + 50))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_passages_by_true_substring_search(spark):
    """Every passage of 50 words goes whole, wherever chunks would end; nothing else does."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeäß漢") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))

    rows = [(i, prose(150)) for i in range(40)]
    for i in range(40, 160):
        source = rows[i % 40][1].split()
        a, k = rng.randrange(0, 70), rng.choice([40, 48, 49, 50, 51, 53, 60, 80])
        rows.append((i, f"{prose(rng.randrange(0, 40))} {'  '.join(source[a : a + k])}\n{prose(rng.randrange(0, 40))}"))
    one, two = rows[3][1].split(), rows[5][1].split()
    rows += [(160, " ".join([*one[:49], *two[:49], *one[60:100]])), (161, prose(60) + " the" * 49), (162, prose(30) + " the" * 49)]
    rows += [(163, "la " * 200), (164, prose(9) + " la" * 70), (165, rows[7][1].upper()), (166, None), (167, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sub.without_passages(docs.repartition(5)).collect()}
    want = searched([r for r in rows if r[0] is not None])
    assert len(got) == len(rows) and got[None].text == rows[-1][1] and got[166].text is None
    assert {i: (r.text or "").split() for i, r in got.items() if i is not None} == want
    for i, text in rows:
        kept, at = "", 0
        for a, b in zip(got[i].removed[::2], got[i].removed[1::2]):
            kept, at = kept + text[at:a], b
        assert text is None or kept + text[at:] == got[i].text


def test_rows_of_one_id_with_several_texts(spark):
    passage = corpus()[1][0]
    rows = [(1, passage), (2, f"{passage} end"), (2, corpus(2)[1][0])]
    got = sub.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted([passage, "end", rows[2][1]])
    assert sub.without_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_several_sources_stay(spark):
    """Shorter runs of several earlier documents make no passage, however they follow."""
    rng = random.Random(8)
    sources = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(49))) for i in range(4)]
    rows = sources + [(4, " ".join(t for _, t in sources)), (5, "the " * 40), (6, "so " + "the " * 49)]
    got = {r.doc_id: r for r in sub.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.text for i, r in got.items()} == dict(rows) and not any(r.removed for r in got.values())


def test_every_window_has_a_seed_of_its_own_words():
    """Seeds of equal windows are equal whatever stands around them, in any kind of text."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeäß漢") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    kinds = [
        [rng.choice(words) for _ in range(70)], ["la"] * 70, ["a", "b"] * 35, ["x" * 200, "y"] * 35, ["i"] * 70,
        [rng.choice("ab") for _ in range(70)], [f"w{k}" for k in range(70)],
    ]
    for passage in kinds:
        texts = []
        for blanks in (" ", "  \n\t"):
            around = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(2)]
            texts.append(f"{around[0]} {blanks.join(passage)} {around[1]}")
        seeds = []
        for text in texts + [" ".join(passage)]:
            w = text.split()
            (found,) = list(sub._windows(pa.array([text])))
            at = {tuple(w[n : n + 50]): int(s) for n, s in zip(found[1], found[2])}
            seeds.append([at[tuple(passage[k : k + 50])] for k in range(21)])
        assert seeds[0] == seeds[1] == seeds[2]


def test_cuts_move_little():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]

    def chunks(w):
        data = np.frombuffer(" ".join(w).encode(), np.uint8)
        cuts = sub.word_cuts(sub._word_gear(data, *sub.common.word_spans(data))).tolist()
        return {tuple(w[a + 1 : b + 1]) for a, b in zip(cuts, cuts[1:])}

    before, after = chunks(words), chunks([*words[:1500], "inserted", "words", *words[1500:]])
    assert len(before) > 500 and len(before - after) <= 6
    assert max(map(len, before)) <= sub.NEAR


def thue_morse(n, a="t", b="h"):
    text = a
    while len(text) < n:
        text += text.translate(str.maketrans(a + b, b + a))
    return text


def test_patterned_words_do_not_collide():
    for n in (1024, 4096, 8192):
        one = thue_morse(n)
        two = one.translate(str.maketrans("th", "ht"))
        data = np.frombuffer((one + two).encode(), np.uint8)
        a, b = sub.common.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    data = np.frombuffer(b"abc" * 40, np.uint8)
    start = np.arange(0, 90)
    for size in range(30):
        hashes = sub.common.span_hashes(data, start, start + size)
        assert len(set(hashes.tolist())) == (1 if size == 0 else 3)
        assert (hashes[:3] == hashes[3:6]).all()
