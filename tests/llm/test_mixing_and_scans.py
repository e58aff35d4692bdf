import collections
import random

import duckdb
import pytest

from colophon.llm import license_scan, mixing
from colophon.llm.queries import ORACLES

from .test_oracles import comparable


def targets_brute(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = 3 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_shared_out_again_until_none_is_above(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(9)} | {None: rng.randint(0, 100)}
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(targets_brute(sizes))


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mixed_counts(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by_source = collections.defaultdict(int)
    for r in rows:
        by_source[r.source] += r.taken
    largest = max(r.size for r in rows)
    for r in rows:
        assert abs(by_source[r.source] - r.target) <= 2 * largest
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed_counts(odd_docs.repartition(5)).collect()), key=str)
    assert mixing.mixed_counts(no_docs).count() == 0


def test_stream_holds_each_row_as_often_as_it_is_taken(spark, odd_docs):
    want = collections.Counter()
    for r in mixing.mixed_counts(odd_docs).collect():
        if r.size:
            want[r.doc_id] += r.taken // r.size
    stream = mixing.mixed_stream(odd_docs)
    assert stream.columns == odd_docs.columns
    assert collections.Counter(r.doc_id for r in stream.collect()) == +want


def test_no_source_lags_in_the_stream(spark):
    """At any point of the mix each source has given its share, up to a document."""
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 9), None, f"s{i % 3}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    queued, taken = mixing.mix(docs)
    target = {r.source: r.target for r in queued.select("source", "target").distinct().collect()}
    given = collections.Counter()
    for r in taken.orderBy("finish").collect():
        given[r.source] += r["size"]
        assert given[r.source] <= r.finish * target[r.source] + 1e-6
        for s in target:
            assert given[s] >= r.finish * target[s] - 10


MIT = """Copyright (c) 2020 A

Permission is hereby granted, free of charge, to any person obtaining a copy
""".replace("copy\n", "copy ") + """of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
"""


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in license_scan.scan(docs).orderBy("doc_id").collect()]


def test_licences(spark):
    got = scanned(spark, [MIT, "Prose here.  Licensed under the Apache License, Version 2.0.\nMore. Released under the MIT License.", "This licence is unknown to us.", None, "", "plain " * 50_000])
    assert [r.licences for r in got] == ["MIT", "Apache-2.0; MIT", "", "", "", ""]
    assert [(r.n_known, r.n_unknown) for r in got] == [(4, 0), (2, 0), (0, 1), (0, 0), (0, 0), (0, 0)]
    assert got[0].sequence == "<HOLDER>[MIT]"


def test_longer_rules_take_first_and_order_counts(spark):
    bsd = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
           "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
           "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
           "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
           "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"]
    three, two, turned = ". ".join(bsd), ". ".join(bsd[:3] + bsd[4:]), ". ".join(bsd[::-1])
    assert [r.licences for r in scanned(spark, [three, two, turned])] == ["BSD-3-Clause", "BSD-2-Clause", ""]


APACHE = """# Copyright 2020 A
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.

import os
"""

GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_wrapped_and_commented_sentences(spark):
    got = scanned(spark, [APACHE, GPL, GPL.replace("\n    ", " "), "Title\n" + MIT.replace(", ", ",\r\n * "), "\n" * 50_000 + "license\n" + "\u4e2d" * 50_000])
    assert [r.licences for r in got] == ["Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-or-later", "MIT", ""]
    assert got[0].sequence == "<HOLDER>[Apache-2.0]"
    assert got[1].sequence == got[2].sequence == "[GPL-3.0-or-later]"


@pytest.mark.parametrize("op", ["op1_license_scan", "op2_mixing", "op10_exact_dedup"])
def test_sql_on_odd_rows(spark, odd_docs, op):
    from colophon.llm import exact_dedup

    kept = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    run = {"op1_license_scan": license_scan.scan, "op2_mixing": mixing.mixed_counts, "op10_exact_dedup": lambda d: exact_dedup.exact_dedup(d).drop("repeats")}[op]
    con = duckdb.connect()
    frame = kept.toPandas()
    con.register("documents", frame)
    assert comparable(run(kept).toPandas()) == comparable(con.execute(ORACLES[op]).df())


def test_scan_of_nothing(no_docs):
    assert license_scan.scan(no_docs).count() == 0
