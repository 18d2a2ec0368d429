"""The alignment of two tokenizers against whole texts encoded at once and plain counting."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from mosaiq.llm import alignment, queries

FOLDER = "/opt/tokenizers"


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")


def plain(text, tokenizers):
    """Ids of both sides with their ends, from the whole text; none if the bytes differ."""
    a, b = tokenizers
    if not text:
        return [], []
    of = alignment.byte_of_character()
    whole, out = (" " + text).encode(), []
    names = lambda ids, name: [(i, name(i)) for i in ids]
    sides = (
        [(i, bytes(of[c] for c in n)) for i, n in names(a.encode(" " + text, add_special_tokens=False).ids, a.id_to_token)],
        [(i, bytes([int(n[3:5], 16)]) if re.fullmatch("<0x..>", n) else n.replace("▁", " ").encode()) for i, n in names(b.encode(text), b.id_to_piece)],
    )
    for side in sides:
        if b"".join(x for _, x in side) != whole:
            return [], []
        end, ends = 0, []
        for i, x in side:
            end += len(x)
            ends.append((i, end))
        out.append(ends)
    return tuple(out)


def plain_rows(rows, tokenizers):
    """The query's rows: every link of every document, counted."""
    docs = []
    for doc_id, text in rows:
        a, b = plain(text, tokenizers)
        links = [(i, j) for i, e in a for j in dict.fromkeys(j for j, f in b if f == e)] if len(a) < 400 else None
        if links is None:
            by_end = collections.defaultdict(list)
            for j, f in b:
                by_end[f].append(j)
            links = [(i, j) for i, e in a for j in by_end[e]]
        ends = sorted({e for _, e in a} & {e for _, e in b})
        text_of, lo, p, q = [], 0, 0, 0
        for e in ends:
            one, two = [], []
            while p < len(a) and a[p][1] <= e:
                one.append(str(a[p][0]))
                p += 1
            while q < len(b) and b[q][1] <= e:
                two.append(str(b[q][0]))
                q += 1
            text_of.append(",".join(one) + "|" + ",".join(two))
        docs.append((doc_id, len(a), len(b), len(ends), links, ";".join(text_of)))
    count = collections.Counter(x for d in docs for x in d[4])
    most = collections.Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(k, na, nb, ng, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(t.encode()).hexdigest() if na else "") for k, na, nb, ng, links, t in docs]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_on_a_whole_table(spark, sf_dir, tokenizers):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    same(queries.op12_align_tokenizers(spark, sf_dir).collect(), plain_rows(docs, tokenizers))


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a  \n b", "x\n\n  y z", "\ta\t b", "don't we'll 's", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve café ½ ﬁne Å Å", "日本語 テキスト です", "▁low line", "a ▁ b", "é́ é", "👩‍👩‍👧 family 🎉", "\x00 null \x1f unit \x85 next", "  nbsp x", "　wide 　space", "zero​width", "A" * 3000, "word " * 2000, "  lots   of    spaces     here ", "\r\n windows\r\n lines\r\n", "1234567890 12 3", "#$%&' ()*+", "﻿bom", "مرحبا بالعالم", "עברית", "हिन्दी पाठ", "a b c"]


def test_odd_texts_repeats_and_hot_ids(spark, tokenizers, monkeypatch, tmp_path):
    """Every id of more than one posting is dealt to several tasks here."""
    monkeypatch.setattr(alignment, "BUCKET", 1)
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (8, "a  b"), (8, "a  b"), (None, "a b"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op12_align_tokenizers(spark, str(tmp_path)).collect(), plain_rows(rows, tokenizers))


def test_units_are_encoded_like_whole_texts(tokenizers):
    r = random.Random(5)
    letters = ["a", "B", "é", "×", "ß.", "\u00a0", "\u0085", "\u07ff", "ß", "語", "1", "'", "'s", ".", "-", "_", " ", " ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "​", "🎉", "́", "the", "ing"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    known = alignment.units_of(f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model")
    n_a, n_b, n_groups, groups, *_ = alignment._align_texts(pa.array(texts), known)
    for k, row in enumerate(plain_rows(enumerate(texts), tokenizers)):
        assert (n_a[k].as_py(), n_b[k].as_py(), n_groups[k].as_py()) == row[1:4], texts[k]
        assert hashlib.sha256(groups[k].as_py().encode()).hexdigest() == row[7] or not row[1], texts[k]


def test_forgetting_units_changes_nothing(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    known = alignment.Units(alignment.Side(f"{FOLDER}/byte_bpe_50k.json"), alignment.Side(f"{FOLDER}/piece_bpe_32k.model"))
    for _ in range(3):
        for text in ODD:
            alignment._align_texts(pa.array([text or ""]), known)
    first = [x.to_pylist() for x in alignment._align_texts(pa.array(["some words here", "other words"]), known)]
    assert first == [x.to_pylist() for x in alignment._align_texts(pa.array(["some words here", "other words"]), known)]


def test_no_rows_and_clashing_names(none, clash):
    assert alignment.align(none).count() == 0
    out = alignment.align(clash.withColumn("groups", clash.doc_id).withColumn("n", clash.doc_id))
    assert out.columns == [c for c in clash.columns if c != "text"] + ["n_a", "n_b", "n_groups", "groups", "a", "b", "n"]
    assert out.count() == clash.count()
