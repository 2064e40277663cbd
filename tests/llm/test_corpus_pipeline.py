from __future__ import annotations

import random

import corpus_pipeline
from heliofleet.llm.packing import cut_pieces


def test_pipeline_stage_by_stage(spark, docs_of):
    rnd = random.Random(8)
    stock = {"en": "the and of with that shall be from this are".split(), "xx": "zorp qwix blatz kree umf trel gnor".split()}
    line = "this licence line stands in many documents of the set"
    data = []
    for i in range(60):
        lang = "en" if i % 3 else "xx"
        body = " ".join(f"{rnd.choice(stock[lang])}{rnd.choice(stock[lang])}" for _ in range(40))
        data.append((i, f"{body}\n{line}" if i in (3, 4, 5) else body, lang))
    data += [(100, data[7][1], "en"), (101, data[8][1] + " more", "en"), (102, None, "en"), (103, "123 456", "en"),
             (104, "token = deadbeefdeadbeef1 " + data[9][1][::-1], None)]
    docs = docs_of(data)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        got = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == docs_of([]).columns
        if name == "language ID":
            assert set(got) == {d for d, _, _ in data} - {102, 103}
        if name == "line dedup":
            assert line in got[5] and line not in got[3] and line not in got[4] and got[7] == data[7][1]
    assert set(got) == {d for d, _, _ in data} - {100, 101, 102, 103}
    assert got[104].startswith("[secret] ") and got[7] == data[7][1]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert pieces.count() == cut_pieces(docs).count() and pieces.select("sequence_id").distinct().count() >= 1
