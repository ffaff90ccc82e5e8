"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import components, fingerprints, html_extract, licenses, media, mixing, ngram_join, pieces, suffix_dedup, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n, r):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Originals, exact and near copies, a shared line, odd texts, repeated rows."""
    r = random.Random(7)
    out, base, line = [], prose(150, r), prose(14, r)
    for i in range(30):
        out.append((i, prose(r.randint(2, 200), r)))
    out += [(100 + i, base) for i in range(6)]
    for i in range(30):
        w = base.split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(VOCABULARY)
        out.append((200 + i, " ".join(w)))
    out += [(300 + i, f"{line}\n{prose(20 + i, r)}") for i in range(8)]
    out += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (404, "ONE"), (405, "two words"), (406, "x" * 5000), (407, "ab" * 700), (408, prose(5000, r)), (409, "é ß 漢字 😀 " * 40), (410, "a\x00b")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", None if d % 7 == 0 else f"s{d % 3}", len(t or "")) for d, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ---- toxicity


def labelled(spark, n=240):
    r = random.Random(3)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        s = [prose(8, r) + "." for _ in range(r.randint(2, 6))]
        if bad:
            s[r.randrange(len(s))] = f"{prose(3, r)} {r.choice(['zzvile', 'zzfoul'])} {prose(2, r)}."
        rows.append((i, " ".join(s), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.drop("toxic"), df.select("doc_id", F.lit(1).alias("quality"), "toxic"), rows


def test_toxicity_held_out(spark):
    documents, labels, rows = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(documents, labels).collect()}
    for d, _, y in rows:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= got[d].score <= 1 and got[d].predicted == int(got[d].score >= 0.5)
    held = [(got[d].predicted, y) for d, _, y in rows if got[d].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_toxicity_locates_and_ignores_held_out_labels(spark):
    documents, labels, _ = labelled(spark)
    model = toxicity.train(documents, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.in_training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    assert toxicity.train(documents, flipped) == model
    probe = spark.createDataFrame([(1, "good day. you zzvile thing! fine."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(probe, model, sentences=True).collect()}
    assert [probe.first().text[s.start : s.end].strip() for s in got[1].spans] == ["you zzvile thing!"]
    assert got[2].score == got[3].score == 0.0 and got[2].spans == []


def test_noisy_or_equals_the_product(spark):
    m = toxicity.Model({"bad": 3.0, "worse": 4.0}, -2.0)
    text = "a bad day. fine. worse and bad!\nplain"
    _, z = m.logits(text)
    assert m.score(text) == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z))))


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 0.01 for r in toxicity.toxicity_scores(docs, none).collect()} == {True}
    assert toxicity.toxicity_scores(empty, none).count() == 0


def test_toxicity_odd_rows(spark):
    """Clashing names, one id with two texts, repeated rows, a null id and a very long text."""
    documents, labels, _ = labelled(spark)
    twice = documents.unionByName(documents.filter("doc_id < 9").withColumn("text", F.lit("zzvile.")))
    assert toxicity.train(twice.repartition(3), labels) == toxicity.train(twice.repartition(7, "text"), labels)
    model = toxicity.train(documents, labels)
    rows = [(1, "fine.", 5, "a"), (1, "fine.", 5, "a"), (None, "you zzvile.", 6, "b"), (2, None, 7, None), (3, "fine day. " * 200_000 + "zzvile you.", 8, "c")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int, _text string").withColumn("c0", F.lit(1)).withColumn("score_1", F.lit(2))
    kept = toxicity.non_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(r.score for r in kept.collect()) == [5, 5, 7]


# ---- licences


NOTICES = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Whole short licences, put together from their printed sentences.
WHOLE = {
    "MIT": "MitGrant MitNoticeKept AsIs MitLiability",
    "BSD-2-Clause": "BsdGrant BsdSource BsdBinary BsdAsIs BsdLiability",
    "BSD-3-Clause": "BsdGrant BsdSource BsdBinary BsdNames BsdAsIs BsdLiability",
    "ISC": "IscGrant IscAsIs IscLiability",
    "Zlib": "ZlibAsIs ZlibLiability ZlibGrant ZlibOrigin ZlibAltered ZlibNotice",
    "BSL-1.0": "BslTitle BslGrant",
    "AGPL-3.0-or-later": "Agpl3Grant GplNoWarranty AgplSee AgplCopy",
    "EPL-2.0": "Epl2Title EplTerms",
    "CC0-1.0": "Cc0Waiver",
    "CC-BY-NC-SA-4.0": "CcByNcSaNotice",
}


def test_published_licences_wrapped_and_not(spark):
    import textwrap

    printed = {i: t for t, i in licenses.SENTENCES.items()} | {i: " ".join(t.split()) for t, i in licenses.CANONICAL.items()}
    # sentences that the table holds without the stop they are printed with
    full = lambda i: printed[i] + ("" if printed[i].endswith((".", ":", "/", "3")) else ".")
    texts = NOTICES | {name: "\n\n".join(map(full, ids.split())) for name, ids in WHOLE.items()}
    rows = []
    for name, t in texts.items():
        for form in (t, *("\n\n".join(textwrap.fill(p, width) for p in t.split("\n\n")) for width in (72, 40)), "\n".join(f" * {x}" for p in t.split("\n\n") for x in [*textwrap.wrap(p, 70), ""])):
            rows.append((name, f"Copyright (c) 2020 Somebody\n\n{form}\n\nint main() {{}}\n"))
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.document_licenses(df).collect()}
    for i, (name, t) in enumerate(rows):
        assert got[i] == (name, ""), (name, t)


def test_every_known_sentence_bears_a_hint():
    for s in licenses.KNOWN:
        assert re.search(licenses.HINT, s), s
    names = set(licenses.KNOWN.values())
    assert all(set(ids) <= names for _, ids in licenses.RULES)


def test_licenses_by_hand(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    rows = [(1, mit), (2, "Hello.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. Bye"), (3, None), (4, ""), (5, "The software is provided as is, without warranty of any kind."), (6, "Permission to speak. licence?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.unmatched) for r in licenses.document_licenses(df).collect()}
    assert got[1] == ("MitGrant,MitNoticeKept,AsIs", "MIT", "")
    assert got[2] == ("MitNotice,CcByNcNotice", "MIT,CC-BY-NC-4.0", "")
    assert got[3] == got[4] == got[6] == ("", "", "")
    assert got[5] == ("AsIs", "", "AsIs")
    assert licenses.document_licenses(empty).count() == 0


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.""",
    "GPL-2.0-or-later": """    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0-or-later": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "Apache-2.0": """ * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def test_wrapped_licence_headers(spark):
    rows = [(i, end.join(x.split("\n"))) for i, (x, end) in enumerate((x, end) for x in WRAPPED.values() for end in ("\n", "\r\n"))]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.document_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (name, "") for i, name in enumerate(name for name in WRAPPED for _ in range(2))}


# ---- SentencePiece


needs_model = pytest.mark.skipif(not __import__("os").path.exists(pieces.MODEL_PATH), reason="no model file")


@needs_model
def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    odd = spark.createDataFrame([(900, "  two  spaces "), (901, "▁"), (902, "tab\there\r\nend"), (903, "https://a.b/c?d=e&f=" + "0123456789abcdef" * 20), (904, "ﬁ ¼ ﷺ ​ zero"), (905, "a" * 70)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd)
    model = pieces.PieceModel.load()
    got = pieces.decode_documents(pieces.encode_documents(df, model, block_bytes=20_000), model).collect()
    text = {r.doc_id: r.text or "" for r in df.collect()}
    assert len(got) == len(text)
    for r in got:
        assert r.ids == lib.encode(text[r.doc_id]), r.doc_id
        assert r.text == lib.decode(r.ids)


@needs_model
@pytest.mark.parametrize("n", [59, 60, 61, 10_000])
def test_long_words_equal_the_library(spark, n):
    """Words about the length beyond which the lattice gives way to the same rules in Python."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(n)
    syllables = "tion the en ing é ß a er ed ment qu über s".split()
    texts = ["".join(r.choice(syllables) for _ in range(n))[: n - 1] for _ in range(5)] + ["a" * (n - 1), "漢" * (n - 1), ("the漢" * n)[: n - 1]]
    model = pieces.PieceModel.load()
    got = {x.doc_id: x.ids for x in pieces.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        assert got[i] == lib.encode(t), i
        assert model.encode_word(pieces.SPACE + t) == lib.encode(t) or "漢" in t


@needs_model
def test_words_reach_their_blocks_packed(spark):
    """A row for each task and block, and in it every word of the block once, with its ids."""
    model = pieces.PieceModel.load()
    texts = [(b, f"the {'xyz'[b % 3]}ab{b % 11}, w{b}.  two   " + " " * (b % 2) + ("x" * 70) * (b % 5 == 0)) for b in range(150)] + [(3, "   "), (149, "▁ the")]
    df = spark.createDataFrame(texts, "block int, text string").repartition(3)
    want: dict[int, set[str]] = {}
    for b, t in texts:
        want.setdefault(b, set()).update(w for x in pieces._TOKENS.findall(pieces.SPACE + t.replace(" ", pieces.SPACE)) for w in __import__("re").findall(model.pattern, x))
    lexicon = pieces.segmented(pieces.words_of_blocks(df, model), model)
    rows = pieces.words_to_blocks(lexicon.coalesce(2), len(model.names)).collect()
    assert len(rows) <= 2 * 150
    got: dict[int, list] = {}
    for r in rows:
        words, ids, ends = pieces.unpack([bytes(r.frame)])
        got.setdefault(r.block, []).extend((w, ids[a:b].tolist()) for w, a, b in zip(words.to_pylist(), ends[:-1], ends[1:], strict=True))
    assert {b: sorted(w for w, _ in x) for b, x in got.items()} == {b: sorted(w) for b, w in want.items()}
    assert all(ids == model.encode_word(w) for x in got.values() for w, ids in x)


@needs_model
def test_texts_of_ids_are_decoded_alike_at_once():
    import numpy as np

    model = pieces.PieceModel.load()
    speller = pieces.Speller(model.names, model.byte_ids, model.unk_id)
    whole = [model.encode_word(pieces.SPACE + t) for t in ("the", "漢", pieces.SPACE + "a")] + [[], [model.unk_id], [model.byte_ids[32], model.byte_ids[65]]]
    for lists in (whole, [*whole, [model.byte_ids[0xE6]]]):
        ids, ends = np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])
        assert speller.texts(ids, ends).to_pylist() == [speller.decode(x) for x in lists]


@needs_model
def test_pieces_of_an_empty_table(spark, empty):
    assert pieces.encode_documents(empty, pieces.PieceModel.load()).count() == 0


def test_best_path_equals_brute_force(spark):
    r = random.Random(1)
    table = {"".join(p): (i, -r.random() * 9) for i, p in enumerate({tuple(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(40)}, 1)}
    model = pieces.PieceModel(pieces.UNIGRAM, table, None, 0, ["<unk>"] + list(table))

    def score(parts):
        return sum(table[p][1] if p in table else model.unk_score for p in parts)

    def every(w):
        if not w:
            yield []
        for k in range(1, len(w) + 1):
            if k == 1 or w[:k] in table:
                yield from ([w[:k], *rest] for rest in every(w[k:]))

    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(40)]
    got = {x.word: x.ids for x in pieces.segmented(spark.createDataFrame([(w,) for w in set(words)], "word string"), model).collect()}
    for w in words:
        best = max(map(score, every(w)))
        parts = [model.names[i] for i in got[w]]
        assert sum(table[p][1] if p in table else model.unk_score for p in parts) == pytest.approx(best)
        assert got[w] == model.encode_word(w)


# ---- HTML


def test_html_main_text():
    page = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies</div><header>Top</header><article><h1>Head &amp; tail</h1><p>First   para&nbsp;here<br>line</p><p>Ti.<p>Unclosed <b>bold</article><aside>side</aside><div id='comments'><p>nice post</p></div><form><label>Mail</label><input></form><footer>&copy; me</footer></body></html>"
    assert html_extract.main_text(page) == "Head & tail\n\nFirst para here\n\nline\n\nTi.\n\nUnclosed bold"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p") == ""


def test_html_without_article_uses_words():
    text = " ".join("this is the text of the story and it was told by all that have read it".split() * 6)
    page = f"<body><div><a href=1>one</a> <a href=2>two</a></div><div><h2>Title</h2><p>{text}</p><p>Short.</p><p>{text}</p></div><div>copyright 2020</div></body>"
    assert html_extract.main_text(page) == f"Title\n\n{text}\n\nShort.\n\n{text}"


def stripped(page):
    """The page without the names that tell its article and its furniture."""
    page = re.sub(r"<(/?)(article|main|nav|aside|header|footer|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r'\s(class|id|role)="[^"]*"', "", page)


PAGES = __import__("pathlib").Path("/root/testdata/sf0.01/pages.parquet")


@pytest.mark.skipif(not PAGES.exists(), reason="test tables are absent")
def test_html_passes_find_the_text_without_markup_names():
    import pyarrow.parquet as pq

    hit = found = wanted = 0
    for page in pq.read_table(PAGES, columns=["html"]).column("html").to_pylist():
        a, b = (collections.Counter(html_extract.main_text(x).split()) for x in (page or "", stripped(page or "")))
        hit, found, wanted = hit + sum((a & b).values()), found + sum(b.values()), wanted + sum(a.values())
    assert hit / found > 0.95 and hit / wanted > 0.95


def test_html_both_passes_decide(monkeypatch):
    """In an article too: the first pass drops a list of links, the second keeps short paragraphs."""
    text = " ".join("this is the text of the story and it was told by all that have read it".split() * 6)
    links = "".join(f"<a href=/{i}>word{i} other{i} more{i}</a> " for i in range(9))
    page = f"<article><h1>Head</h1><p>{text}</p><p>Short.</p><div>{links}</div></article><div>{text}</div>"
    assert html_extract.main_text(page) == f"Head\n\n{text}\n\nShort."
    with monkeypatch.context() as m:
        m.setattr(html_extract, "first_pass", lambda b, trusted: "short")
        assert "word1" in html_extract.main_text(page)
    monkeypatch.setattr(html_extract, "second_pass", lambda blocks, first, trusted: first)
    assert html_extract.main_text(page) == text


def test_html_article_around_a_teaser_is_not_trusted():
    text = " ".join("this is the text of the story and it was told by all that have read it".split() * 6)
    page = f"<article><p>Read this too.</p></article><div><h1>Head</h1><p>{text}</p><p class=social>{text}</p></div>"
    assert html_extract.main_text(page).startswith(f"Head\n\n{text}")


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a b</p></article>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in html_extract.page_texts(df).orderBy("page_id").collect()] == [(1, "a b", 3), (2, "", 0)]
    assert html_extract.page_texts(df.limit(0)).count() == 0
    odd = df.select("page_id", "html", F.lit(1).alias("_html"), F.lit("a").alias("page"), F.lit(None).cast("string").alias("c0"))
    assert [tuple(r) for r in html_extract.extract_pages(odd).orderBy("page_id").collect()] == [(1, 1, "a", None, "a b"), (2, 1, "a", None, "")]


# ---- mixing


def test_targets_are_capped_and_reshared():
    t = mixing.capped_targets({"a": 1000, "b": 10, "c": 500}, mixing.cyclic_weights(["b", "a", "c"]))
    assert sum(t.values()) == pytest.approx(1510) and t["b"] == 30
    assert t["a"] / t["c"] == pytest.approx(1 / 3)
    assert mixing.cyclic_weights([None, "b", "a", "é"]) == {"a": 1, "b": 2, "é": 3, None: 1}


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    assert sorted(mixing.permuted(np.arange(n), n, 99).tolist()) == list(range(n))


def test_mix(spark, docs, empty):
    rows = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    text = {d: t or "" for d, t in corpus()}
    assert rows.keys() == text.keys()
    by = collections.defaultdict(list)
    for d, r in rows.items():
        assert r.size == len(WORD.findall(text[d])) and 0 <= r.taken <= 3 * r.size
        by[r.source].append(r)
    for s, rs in by.items():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= mixing.BLOCK_WORDS + 0.02 * rs[0].target, s
    assert {d: r.taken for d, r in rows.items()} == {r.doc_id: r.taken for r in mixing.mixed(docs.repartition(5)).collect()}
    assert mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("group", [1024, 2])
def test_mix_against_one_process(docs, group, monkeypatch):
    """The words taken, worked out in one process: documents in hash order, slots 0 .. quota - 1 of each
    source through its permutations, and the words of the blocks they fall on."""
    monkeypatch.setattr(mixing, "SHARD_GROUP", group)
    mix = mixing.Mix(docs.filter("doc_id % 5 > 0"), block_words=8, shard_blocks=16)
    rows = docs.filter("doc_id % 5 > 0").select("doc_id", "source", "text", F.xxhash64(F.col("doc_id"), F.lit(mixing.SEED)).alias("h")).collect()
    sizes, words = collections.Counter(), {}
    for r in rows:
        words[r.doc_id] = len(WORD.findall(r.text or ""))
        sizes[r.source] += words[r.doc_id]
    given = mixing.cyclic_weights(list(sizes))
    quotas = mixing.block_quotas(sizes, mixing.capped_targets(sizes, given), 8)
    want = collections.Counter()
    for s, size in sizes.items():
        n, owner = -(-size // 8), []
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.h, r.doc_id)):
            owner += [r.doc_id] * words[r.doc_id]
        for i in range(quotas[s]):
            block = int(mixing.permuted(np.array([i % n]), n, mixing._key(mixing.SEED, s) + i // n)[0])
            want.update(owner[block * 8 : block * 8 + 8])
    assert {r.doc_id: r.taken for r in mix.taken().collect()} == {d: want[d] for d in words}
    slots = collections.Counter((r.source_no, r.slot) for r in mix.slots.collect())
    assert slots == collections.Counter({(i, k): 1 for i, s in enumerate(given) for k in range(quotas[s])})
    shards = collections.Counter(r.shard for r in mix.slots.collect())
    assert set(shards.values()) <= {16, sum(quotas.values()) % 16}


def test_mix_with_clashing_names(docs):
    more = docs.withColumn("size", F.lit("a")).withColumn("start", F.lit(0)).withColumn("_bucket", F.lit(1)).withColumn("block", F.lit(2))
    assert mixing.mixed(more).count() == docs.count()
    out = mixing.mixed_documents(more)
    assert out.columns == more.columns and out.count() == mixing.mixed_documents(docs).count()


def test_mixed_rows_hold_the_words_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs).collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert {d: n for d, n in taken.items() if n} == dict(got)


# ---- WARC


def test_warc_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    rows = [(i, "u", "".join(chr(r.randint(33, 126)) for _ in range(40_000))) for i in range(12)] + [(20, "u", "same" * 100), (21, "u", "same" * 100), (None, "u", "same" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(warc.mark_revisits(df), str(tmp_path / "cut"), archive_bytes=100_000)
    sizes = [f.stat().st_size for f in (tmp_path / "cut").rglob("part-*")]
    assert len(sizes) > 2 and max(sizes) < 180_000
    assert warc.read_archives(spark, path, "part-*").filter("kind = 'record'").count() == len(rows)
    few = sorted(map(str, warc.archive_round_trip(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.archive_round_trip(df).collect())) == few


def test_warc_round_trip(spark):
    big = "<p>" + "ü" * 200
    rows = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", big), (1, "u", "tiny"), (2, "u", "tiny"), (4, "u", None), (7, "u", ""), (8, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" + "\x1f\x8b" * 50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = {r.page_id: r for r in warc.archive_round_trip(df).collect()}
    assert len(got) == len(rows)
    for d, _, h in rows:
        b = (h or "").encode()
        assert (got[d].payload_bytes, got[d].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert [(d, got[d].record_type, got[d].refers_to) for d in (3, 5, 9, 1, 2)] == [(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (1, "response", None), (2, "response", None)]
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def _record(i, payload):
    return warc.record_bytes(str(i), "u", payload, "response", hashlib.sha256(payload).hexdigest(), None, len(payload))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    r = random.Random(2)
    plain = [_record(i, bytes(r.randrange(256) for _ in range(r.randint(0, 90_000)))) for i in range(6)]
    members = [warc.gzip_member(x) if packed else x for x in plain]
    good = b"".join(members)
    assert [x["record_id"] for k, x in warc.salvage(good)] == [f"<urn:page:{i}>" for i in range(6)]
    broken = bytearray(good)
    at = len(members[0]) + len(members[1]) // 2
    broken[at : at + 20] = b"\0" * 20
    del broken[len(good) - 10 :]
    out = list(warc.salvage(b"junk" + bytes(broken)))
    assert [x["record_id"] for k, x in out if k == "record"] == [f"<urn:page:{i}>" for i in (0, 2, 3, 4)]
    assert [k for k, _ in out].count("gap") == 3
    assert sum(x["length"] for _, x in out) == 4 + len(broken)
    assert all(a["offset"] + a["length"] == b["offset"] for (_, a), (_, b) in zip(out, out[1:]))


def _ids_and_gaps(data):
    out = list(warc.salvage(data))
    return [x["record_id"][10:-1] for k, x in out if k == "record"], [(x["offset"], x.get("inner_offset")) for k, x in out if k == "gap"]


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_within_one_member(level):
    r = random.Random(4)
    plain = [_record(i, bytes(r.randrange(256) for _ in range(9000))) for i in range(8)]
    pack = lambda x: gzip.compress(x, level, mtime=0)
    wrong = list(plain)
    wrong[2] = wrong[2].replace(b"Content-Length: 9000", b"Content-Length: 9001")
    wrong[5] = wrong[5].replace(b"sha256:", b"sha256:0")
    at = len(plain[0]) + len(plain[1])
    assert _ids_and_gaps(pack(b"".join(wrong))) == (["0", "1", "3", "4", "6", "7"], [(0, at), (0, sum(map(len, wrong[:5])))])
    whole, after = pack(b"".join(plain)), warc.gzip_member(_record(9, b"next"))
    ids, gaps = _ids_and_gaps(whole[: len(whole) // 2])
    assert ids in (["0", "1", "2"], ["0", "1", "2", "3"]) and gaps[-1] == (0, None)
    # a wrong checksum: all of it can be read, and the member after it is found
    broken = bytearray(whole)
    broken[-8] ^= 1
    out = list(warc.salvage(bytes(broken) + after))
    assert [x["record_id"][10:-1] for k, x in out if k == "record"] == [*map(str, range(8)), "9"]
    assert all("checks" in x["reason"] or "check" in x["reason"] for k, x in out[:9])
    assert [(x["offset"], x["length"]) for k, x in out if k == "gap"] == [(0, len(whole))]


def test_empty_member_is_gzip():
    assert gzip.decompress(warc.EMPTY_MEMBER) == b"" and len(warc.EMPTY_MEMBER) == 20


# ---- n-gram join


def shingles(t, k):
    w = WORD.findall((t or "").translate(str.maketrans(ngram_join.UPPER, ngram_join.LOWER)))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and o * den >= (len(sets[a]) + len(sets[b]) - o) * num and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_ngram_components(docs, k, num, den):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.JaccardJoin(docs, k, num, den).membership().collect()}
    assert got == brute_components(corpus(), k, num, den)


def test_one_id_with_two_texts(spark):
    r = random.Random(41)
    a, b = prose(60, r), prose(60, r)
    df = spark.createDataFrame([(1, a, "x"), (1, b, "x"), (2, a + " end", "y"), (3, b + " end", "z"), (4, prose(60, r), None)], "doc_id long, text string, tokens string")
    got = sorted((x.doc_id, x.component_id) for x in ngram_join.ngram_components(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_ngram_edges(spark, docs, empty):
    assert ngram_join.ngram_components(empty).count() == 0
    twice = docs.unionByName(docs)
    assert ngram_join.ngram_components(twice).count() == twice.count()
    kept = ngram_join.keep_representatives(twice).select("doc_id").collect()
    assert len(kept) == len({r.doc_id for r in kept}) and {r.doc_id for r in kept} == {d for d, (_, c) in brute_components(corpus(), 5, 4, 5).items() if c == d}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


def test_components_of_shuffled_chains(spark):
    r = random.Random(11)
    ids = r.sample(range(5000), 1400)
    chains = ids[:1000], ids[1000:1399]
    links = [(a, b) if r.random() < 0.5 else (b, a) for chain in chains for a, b in zip(chain, chain[1:])]
    r.shuffle(links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(chain) for chain in chains for x in chain}


# ---- fingerprints


def test_fingerprints(spark, docs, empty):
    rows = sorted((d, t or "") for d, t in corpus())
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    estimates = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        words = lambda x: frozenset(tuple(w) for w in [WORD.findall(x)[j : j + 5] for j in range(max(1, len(WORD.findall(x)) - 4))])
        a, b = words(t), words(edited)
        estimates.append(abs(got[d].near_edited - len(a & b) / len(a | b)))
    assert np.mean(estimates) < 0.05 and max(estimates) < 0.35
    same = collections.defaultdict(set)
    for d, t in rows:
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_next_row_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 40)
    ids = [None, 5, 1, 1, 9, 100, 7, 8, 2, 3]
    df = spark.createDataFrame([(i, f"t{n}", 20) for n, i in enumerate(ids)], "k long, v string, n long")
    order = sorted(((-1 if i is None else i), f"t{n}") for n, i in enumerate(ids))
    want = {v: order[(j + 1) % len(order)][1] for j, (_, v) in enumerate(order)}
    assert {r.v: r.next_v for r in fingerprints.with_next(df, "k", ["v"], "n").collect()} == want


# ---- media


def test_codecs_round_trip():
    r = np.random.default_rng(1)
    for shape in ((1, 24), (7, 5), (48, 24)):
        a = r.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_pgm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    assert (media.decode(b"P6\n# c\n2 1\n255\n" + bytes(range(6))) == np.arange(6).reshape(1, 2, 3)).all()
    assert media.decode(b"P2 2 2 9\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P4 9 1\n\x80\x80").tolist() == [[0, 255, 255, 255, 255, 255, 255, 255, 0]]
    for bad in (b"", b"P5", b"P5 2 2 255\n123", b"P5 0 2 255\n", b"BMxx", b"GIF89a"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_area_resize_is_a_mean():
    a = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.area_resize(a, 3, 4), a.reshape(3, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(a, 12, 16), np.repeat(np.repeat(a, 2, 0), 2, 1))
    assert np.isclose(media.area_resize(a, 5, 3).mean(), a.mean())


@pytest.mark.parametrize("fmt", ["pgm", "bmp"])
def test_stored_texts(docs, empty, fmt):
    got = {r.doc_id: r for r in media.stored_texts(docs, fmt).collect()}
    by_text = collections.defaultdict(set)
    for d, t in corpus():
        raw = (t or "").encode()
        pad = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:])), d
        by_text[raw].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.stored_texts(empty, fmt).count() == 0


# ---- suffix-array dedup


def brute_removed(rows, least=100):
    seen, out = set(), {}
    for d, t in sorted((d, t or "") for d, t in rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(b[i : i + least])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [4096, 3])
def test_repeats_against_brute_force(docs, bucket, monkeypatch):
    real = suffix_dedup.SuffixDedup
    monkeypatch.setattr(suffix_dedup, "SuffixDedup", lambda d: real(d, bucket=bucket))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removal_digest(docs).collect()}
    assert got == brute_removed(corpus())


@pytest.mark.parametrize("bucket", [4096, 3])
def test_repeats_with_equal_rows(spark, bucket, monkeypatch):
    r = random.Random(13)
    shared = [prose(60, r) for _ in range(4)]
    rows = [(i, f"{prose(20, r)} {r.choice(shared)[i:]} {prose(20, r)} {r.choice(shared)}") for i in range(12)]
    rows += [(None, f"{shared[0][3:]} {prose(9, r)} {shared[1][5:]}")]
    df = spark.createDataFrame(rows + rows[:5] + rows[3:7] + rows[-1:] * 2, "doc_id long, text string")
    real = suffix_dedup.SuffixDedup
    monkeypatch.setattr(suffix_dedup, "SuffixDedup", lambda d: real(d, bucket=bucket))
    got = collections.defaultdict(list)
    for x in suffix_dedup.removal_digest(df).collect():
        got[-1 if x.doc_id is None else x.doc_id].append(tuple(x)[1:])
    want = brute_removed([(-1 if d is None else d, t) for d, t in rows])
    assert {d: set(v) for d, v in got.items()} == {d: {v} for d, v in want.items()}
    assert [len(got[d]) for d in (0, 3, 4, 6, 7, -1)] == [2, 3, 3, 2, 1, 3]


def test_repeats_of_a_large_bucket(spark):
    """A phrase and a passage in over 1,024 different surroundings, at the shipped bucket size, and a
    text longer than a chunk."""
    r = random.Random(31)
    phrase, passage = prose(16, r)[:70], prose(40, r)[:130]
    rows = [(i, f"{prose(9, r)} {i}{phrase}{i * 7} {prose(8, r)} {i * 3}{passage}{i * 11}") for i in range(1500)]
    rows.append((2000, prose(70_000, r) + passage))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: tuple(x)[1:] for x in suffix_dedup.removal_digest(df).collect()} == brute_removed(rows)


def test_suffix_array_against_sorting():
    r = random.Random(2)
    for _ in range(100):
        texts, least = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 6))], r.randint(1, 5)
        number, start, common = suffix_dedup.suffix_array(texts, least)
        found = [texts[n][i:] for n, i in zip(number, start, strict=True)]
        assert found == sorted(t[i:] for t in texts for i in range(len(t) - least + 1))
        for x, y, n in zip(found, found[1:], common, strict=False):
            assert x[:n] == y[:n] and x[n : n + 1] != y[n : n + 1] or x == y


def test_repeats_of_an_empty_table(empty):
    assert suffix_dedup.removal_digest(empty).count() == 0


def test_maximal_repeats_by_hand():
    out = {(n, tuple(sorted(x))) for n, x in suffix_dedup.maximal_repeats([b"xabcabcy", b"zabcq"], 2)}
    assert out == {(3, ((0, 1), (0, 4), (1, 1)))}
    out = {(n, tuple(sorted(x))) for n, x in suffix_dedup.maximal_repeats([b"aaaa"], 2)}
    assert out == {(3, ((0, 0), (0, 1))), (2, ((0, 0), (0, 1), (0, 2)))}


def test_cut_texts_keep_code_points(spark):
    p = "ñandú " * 30
    df = spark.createDataFrame([(1, p + "uno", "x"), (2, "dos " + p, "y"), (3, None, "z")], "doc_id long, text string, extra string")
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(df).collect()}
    assert got[3] is None and got[2].startswith("dos") and len(got[2]) < 130 and "�" not in got[2]
    assert suffix_dedup.without_repeats(df).columns == df.columns


# ---- pipeline


@needs_model
def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    df = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, d)
        assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString(), name
        out.write.parquet(f"{d}/{name}")
        df = spark.read.parquet(f"{d}/{name}")
    encoded = corpus_pipeline.STAGES[-1][1](spark, df, d)
    assert encoded.count() == df.count() and encoded.columns == ["doc_id", "n_pieces", "ids"]
