"""Fill-in-the-middle and tokenizer alignment against plain Python."""

import hashlib
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import brute
import pytest
from pyspark.sql import functions as F

from ethoframe.llm import alignment, fim, queries

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = [(None, None), (None, "null id one two three"), (900, None), (901, ""), (902, " \n\t "), (903, "a <P> b"), (904, "x<S>"), (905, "<M"), (906, "< P><S >"), (907, "日本語 テキスト 😀 é\x0b\x0cz " * 30),
       (908, "repeated row"), (908, "repeated row"), (909, "▁ piece mark"), (910, "two  spaces   three "), (911, "<s> <unk> <0x41> <|endoftext|>"), (912, "=" * 3000), (913, "word " * 20000), (914, "\x00nul\x00")]


def cut(doc_id, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text, key = text or "", "" if doc_id is None else str(doc_id)
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture
def rows(spark, documents):
    made = [(d, t) for d, t, *_ in documents] + ODD
    return made, spark.createDataFrame(made, "doc_id long, text string").repartition(3)


def test_fill_in_middle(rows):
    made, docs = rows
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == Counter((d, t, *cut(d, t), t or "") for d, t in made)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"one two three {i}", "mine", 7) for i in range(200)], "doc_id long, text string, form string, n long")
    plan = fim.Plan(seed=7, rate=100, suffix_first=0, prefix="[p'.", suffix="[s|", middle="[m\\")
    out = fim.fill_in_middle(docs, plan)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"), plan)).collect()
    assert {r.form for r in got} == {"psm"} and all(r.back == r.text and r.output.startswith("[p'.") for r in got)


def aligned(made):
    """Rows of the contract by offsets: groups end where a token of A and one of B end."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.A_FILE}")
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.B_FILE}")
    alphabet, names = alignment.byte_alphabet(), {i: w for w, i in one.get_vocab().items()}
    found = []
    for doc_id, text in made:
        spaced = (" " + (text or "")).encode()
        a = one.encode(spaced.decode(), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        bytes_a = [bytes(alphabet[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != spaced or b"".join(bytes_b) != spaced:
            found.append((doc_id, [], [], []))
            continue
        ends = [list(accumulate(map(len, x))) for x in (bytes_a, bytes_b)]
        groups, low = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            high = [bisect_right(e, end) for e in ends]
            groups.append((a[low[0] : high[0]], b[low[1] : high[1]]))
            low = high
        found.append((doc_id, a, b, groups))
    counts = Counter()
    links = []
    for _, _, _, groups in found:
        c = Counter()
        for x, y in groups:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    c[i, j] += n * m
        links.append(c)
        counts.update(c.keys())
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for (doc_id, a, b, groups), c in zip(found, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(a), len(b), len(groups), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items()), brute.sha(text) if groups else ""))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("hot", [alignment.HOT, 50])
def test_align_tokenizers(rows, hot):
    made, docs = rows
    got = alignment.align_tokenizers(docs.withColumn("n_a", F.lit("clash")), hot=hot).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(aligned(made))


def test_large_groups_and_packing():
    import numpy as np

    a, b = np.array([5, 6, 5] * 100 + [9]), np.array([1, 2] * 40 + [3])
    pairs, links = alignment.linked_pairs(a, b, np.array([300, 301]), np.array([80, 81]))
    assert dict(zip(pairs.tolist(), links.tolist(), strict=True)) == {5 << 15 | 1: 8000, 5 << 15 | 2: 8000, 6 << 15 | 1: 4000, 6 << 15 | 2: 4000, 9 << 15 | 3: 1}
    back = alignment.unpack(alignment.pack(pairs, links))
    assert (back[0] == pairs).all() and (back[1] == links).all()


def test_the_walk_stops_where_bytes_differ():
    walk = alignment.Transducer([b"ab", b"c"], [b"a", b"bc", b"x"])
    assert [x.tolist() for x in walk.cuts([0, 1], [0, 1])] == [[2], [2]]
    assert walk.cuts([0, 1], [0, 2]) is None and walk.cuts([0], [0]) is None and walk.cuts([0, 1], [0, 1, 2]) is None and [x.tolist() for x in walk.cuts([], [])] == [[], []]


ODD_TEXTS = [
    "a b a b", "  a", "a\n \nb c", "a \n b", "a\n b a\n", "a b\n", "q b\n c", "b\n", "foo\x1c bar  baz", "x\u00a0 y", "a ", "\u2581x y", "\n\n a\t b  c", "  ",
    "\u65e5\u672c \u30c6\u30ad\u3000x", "x" * 5000 + " y", "a" * 70 + " " + "b" * 200, " ".join(["\u0301\U0001f600e"] * 50), "it's n't  'll 12 3.4,5",
]


def test_units_of_texts_equal_whole_walks():
    walks = alignment.Aligner(alignment.TOKENIZERS)
    for _ in range(2):  # the second time from memory
        for text in ODD_TEXTS:
            assert walks.row(text) == walks._whole(text), text
    assert walks.known and not any(u[-1].isspace() or len(u) >= alignment.LONG_UNIT for u in walks.known)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(empty).count() == 0 and alignment.align_tokenizers(empty).count() == 0


def test_alignment_of_a_driver_table(spark):
    sf = "/root/testdata/sf0.001"
    made = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_align_tokenizers(spark, sf).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == Counter(aligned(made))
