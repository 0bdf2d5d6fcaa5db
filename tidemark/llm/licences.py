"""Operator 4: licence scan by a trained paragraph classifier, in SQL expressions and spark.ml.

Paragraphs are the lines of a text, and the runs of lines between blank lines, so that a notice is seen as one line
or wrapped over several. Their word 1-grams and 2-grams, each counted once, feed a multinomial
logistic regression whose elastic-net penalty leaves few of them with weights. It learns licence families from
the notices below, whole and with each word left out in turn, and the class ``unknown`` from talk about licences
and a bounded sample of the documents' lines: the ``SAMPLE`` with the smallest hashes, whatever the corpus, but for
those that hold a notice. A fifth of the sample is held out and calibrates the class: a family must be more
probable than the 99.9th percentile of what it reaches on held-out lines, and than a half.
A prediction is confirmed by comparison with the notices: ``COVER`` of the 3-grams of one of the family's must occur,
as large a share of those that no other family has, and no other family's notice may be covered better; families whose notices are
covered just as well (dual licences) are named too. Notices are the lines that files carry, SPDX identifiers of each family among them, titles, and
the paragraphs of licence bodies that tell most.

A line that lacks the rarest word of each weighted n-gram and of each 3-gram of a notice has none of them, so its
probabilities are those of the intercepts and it isn't looked at further; that is exact, not a prefilter. Features are the n-grams of
the notices that other lines rarely have, so weights are some hundreds of rows whatever the corpus.

Defined results: null and empty texts have no paragraphs; repeated paragraphs count each time; equal rows have equal
results; on a tie of probabilities the family that stands first below is predicted; a text of any length is read
whole; an empty table has no rows; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.storage import materialize

UNKNOWN = "unknown"
SAMPLE = 3000
#: An n-gram that so large a share of other lines have says nothing.
COMMON = 0.01
COVER = 0.5
REGULARISATION = 0.0002

#: Notices of licence families.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU Affero General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work has been dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License 2.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Released under the Eclipse Public License 2.0.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}

#: Titles and telling paragraphs of licence bodies, and dual licences (with both).
BODIES = {
    "MIT": [
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "Dual-licensed under MIT or Apache-2.0.",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
    ],
    "Apache-2.0": [
        "Dual-licensed under MIT or Apache-2.0.",
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "Apache License Version 2.0, January 2004",
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "\"Licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.",
        "\"Legal Entity\" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "GPL": [
        "GNU General Public License Version 3, 29 June 2007",
        "GNU General Public License Version 2, June 1991",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software.",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice.",
    ],
    "LGPL": [
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "GNU Lesser General Public License Version 2.1, February 1999",
    ],
    "AGPL": [
        "GNU Affero General Public License Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "BSD": [
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    ],
    "MPL-2.0": [
        "Mozilla Public License Version 2.0",
    ],
    "EPL-2.0": [
        "Eclipse Public License - v 2.0",
    ],
}
#: Short identifiers of each family, which files carry behind ``SPDX-License-Identifier:``.
IDENTIFIERS = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC0": ["CC0-1.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "ISC": ["ISC"],
    "MPL-2.0": ["MPL-2.0"],
    "EPL-2.0": ["EPL-2.0"],
    "BSL-1.0": ["BSL-1.0"],
    "Unlicense": ["Unlicense"],
}
for _family, _names in IDENTIFIERS.items():
    NOTICES[_family] += BODIES.get(_family, []) + [f"SPDX-License-Identifier: {x}" for x in _names]
for _family in ("MIT", "Apache-2.0"):
    NOTICES[_family].append("SPDX-License-Identifier: MIT OR Apache-2.0")

#: Talk about licences that is none of these notices, for the unknown class.
TALK = [
    "All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
    "Copyright 2019 by the authors. All rights reserved.",
    "Please read this license agreement carefully before you install or use the software.",
    "A driving licence and a copy of the passport must be shown at the desk.",
    "The city council granted the bar a license to serve until two in the morning.",
    "The warranty does not cover damage that comes from use other than the intended one.",
    "See the LICENSE file for details.",
    "The license fee is due each year and must be paid before the first of March.",
    "This product includes software that third parties have licensed to us under their own terms.",
    "We compared how the terms of public licenses changed between version 2.0 and version 3.",
    "Free of charge for members; other persons pay at the door.",
    "You may not use this service except in compliance with these terms of use.",
    "The software is sold under a commercial license only.",
    "Use of this website is governed by the terms of service and the privacy policy.",
    "The above copyright line names the photographer.",
    "Distribution rights were licensed to a studio for an amount that was not published.",
    "He has been a free software advocate since the foundation of the group.",
    "This work was supported by a grant of the national science foundation.",
    "It is provided as is, without any warranty, and support ends with this version.",
    "The library is open to the public; copies can be made in the reading room.",
]


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0))


_WORD = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def _own_words(line: str) -> list[str]:
    return re.findall(_WORD, line.lower())


def _own_grams(line: str, n: int) -> list[str]:
    w = _own_words(line)
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))


def _phrases_of(line: str) -> list[str]:
    """The 3-grams of a notice, the 2-grams of one of two words."""
    return _own_grams(line, min(3, len(_own_words(line))))


def _grams(w: Column, n: int) -> Column:
    parts = [F.slice(w, i + 1, F.greatest(F.size(w) - (n - 1), F.lit(0))) for i in range(n)]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat_ws(" ", x, y)), parts)


def _in(x: Column, known: list[str]) -> Column:
    return x.isin(known) if known else F.lit(False)


def _among(values: Column, known: list[str]) -> Column:
    """Different values that are known; a set is looked up, however many there are."""
    return F.array_distinct(F.filter(values, lambda x: _in(x, known)))


def features(w: Column) -> Column:
    return F.array_distinct(F.concat(w, _grams(w, 2)))


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _phrases() -> list[str]:
    return sorted({g for texts in NOTICES.values() for t in texts for g in _phrases_of(t)})


def _met(w: Column) -> Column:
    """Which n-grams of the notices' comparison are in a paragraph."""
    return _among(F.concat(_grams(w, 2), _grams(w, 3)), _phrases())


def coverage(g3: str) -> Column:
    """For each family the largest share of a notice's 3-grams that are in a column; 0 if under ``COVER`` of those of its own
    are. As text, since a column object for each 3-gram takes seconds to make."""
    grams = {f: [_phrases_of(t) for t in texts] for f, texts in NOTICES.items()}

    def met(known: list[str]) -> str:
        return f"size(filter({g3}, x -> x in ({', '.join(map(_quoted, known))})))"

    def share(family: str, t: list[str]) -> str:
        other = {g for f, ts in grams.items() if f != family for x in ts for g in x}
        own = [g for g in t if g not in other]
        whole = f"{met(t)} / {len(t)}D"
        return f"if({met(own)} >= {COVER * len(own)}D, {whole}, 0D)" if own else whole

    return F.expr("array(" + ", ".join(f"array_max(array({', '.join(share(f, t) for t in ts)}))" for f, ts in grams.items()) + ")")


def notices(spark: SparkSession) -> DataFrame:
    """``(family, words)`` of each notice."""
    rows = ", ".join(f"({_quoted(f)}, {_quoted(t)})" for f, texts in NOTICES.items() for t in texts)
    return spark.sql(f"select * from values {rows} as t(family, line)").select("family", words(F.col("line")).alias("w"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(row, block, place, line)`` of the lines that are not blank; blank lines part the blocks."""
    blocks = docs.select("row", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n[ \t\r]*\n")).alias("block", "lines"))
    return blocks.select("row", "block", F.posexplode(F.split("lines", "\n")).alias("place", "line")).filter(F.length(F.trim("line")) > 0)


def negatives(lines: DataFrame) -> DataFrame:
    """``(w)`` of ``TALK`` and of the ``SAMPLE`` different lines of smallest hash that don't hold a notice."""
    rows = lines.select("line", F.xxhash64("line").alias("h"))
    least = materialize(rows.select("h").groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(SAMPLE).select("h"), "sample")
    chosen = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.first("line").alias("line"))  # at most SAMPLE rows
    found = chosen.select(words(F.col("line")).alias("w")).filter(F.size("w") > 0)
    found = materialize(found.withColumn("g3", _met(F.col("w"))), "lines")
    found = found.filter((F.size("g3") == 0) | (F.array_max(coverage("g3")) < COVER)).select("w")
    talk = lines.sparkSession.sql(f"select inline(array({', '.join(f'struct({_quoted(x)} as line)' for x in TALK)}))")
    return found.unionByName(talk.select(words(F.col("line")).alias("w")))


def _frequencies(base: DataFrame, unknown: DataFrame) -> dict[str, float]:
    """Of each n-gram of the notices the share of the unknown paragraphs that have it."""
    total = max(1, unknown.count())
    mine = base.select(F.explode(features(F.col("w"))).alias("g")).distinct()
    seen = unknown.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return {r["g"]: (r["n"] or 0) / total for r in mine.join(seen, "g", "left").collect()}  # of the notices above


def fit(spark: SparkSession, sample: DataFrame) -> dict:
    """Weights of the n-grams that have any, intercepts, and the least probability of each family."""
    base = notices(spark)
    whole = base.select("family", "w")
    dropped = base.select("family", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"), "w").select(
        "family", F.filter("w", lambda x, k: k + 1 != F.col("i")).alias("w")
    )
    negative = sample.select(F.lit(UNKNOWN).alias("family"), "w", (F.pmod(F.xxhash64("w"), F.lit(5)) == 0).alias("out"))
    names = [UNKNOWN, *NOTICES]
    label = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("family")) - 1
    rows = (
        whole.unionByName(dropped)
        .withColumn("out", F.lit(False))
        .unionByName(negative)
        .select(label.cast("double").alias("label"), features(F.col("w")).alias("grams"), "out")
        .withColumn("weight", F.when(F.col("label") == 0, 1.0).otherwise(4.0))
    )
    rows = materialize(rows.coalesce(1), "training")
    learn = rows.filter("not out")
    share = _frequencies(base, rows.filter("label = 0"))
    vectors = CountVectorizerModel.from_vocabulary(sorted(g for g, x in share.items() if x <= COMMON), "grams", "features")
    model = LogisticRegression(
        family="multinomial", regParam=REGULARISATION, elasticNetParam=0.5, weightCol="weight", maxIter=50, tol=1e-4, standardization=False
    ).fit(vectors.transform(learn))
    matrix, intercepts = model.coefficientMatrix.toArray(), list(model.interceptVector)
    present = sorted({int(x) for x in range(model.numClasses)})
    names = [names[i] for i in present]
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vectors.vocabulary) if abs(matrix[:, i]).max() > 1e-6}
    rarest = {min(g.split(" "), key=lambda w: (share[w], w)) for g in [*weights, *_phrases()]}
    fitted = {"names": names, "weights": weights, "intercepts": intercepts, "rarest": sorted(rarest)}
    one = F.lit(0)
    held = score(rows.filter("out").select(F.monotonically_increasing_id().alias("row"), one.alias("block"), one.alias("place"), "grams"), fitted)
    least = held.agg(*[F.percentile_approx(F.element_at("p", i + 1), 0.999, 1000).alias(f"p{i}") for i in range(len(names))]).first()
    fitted["least"] = [max(0.5, least[i] or 0.0) for i in range(len(names))]
    return fitted


def score(rows: DataFrame, fitted: dict) -> DataFrame:
    """``(row, block, place, p)``: class probabilities of ``rows(row, block, place, grams)`` that have a weighted n-gram."""
    spark, n = rows.sparkSession, len(fitted["names"])
    listed = ", ".join(f"named_struct('g', {_quoted(g)}, 'w', array({', '.join(f'{x!r}D' for x in w)}))" for g, w in fitted["weights"].items())
    weights = spark.sql(f"select inline(array({listed}))")  # n-grams of the notices
    sums = (
        rows.select("row", "block", "place", F.explode("grams").alias("g"))
        .join(F.broadcast(weights), "g")
        .groupBy("row", "block", "place")
        .agg(*[F.sum(F.element_at("w", i + 1)).alias(f"s{i}") for i in range(n)])
    )
    margin = F.array(*[F.col(f"s{i}") + float(b) for i, b in enumerate(fitted["intercepts"])])
    top = sums.select("row", "block", "place", margin.alias("m"))
    odds = top.withColumn("e", F.transform("m", lambda x: F.exp(x - F.array_max("m"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return odds.select("row", "block", "place", F.transform("e", lambda x: x / total).alias("p"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_paragraphs, n_licensed, n_unconfirmed, families, least_probability)`` for each row of
    ``docs(doc_id, text)``: lines that are not blank; confirmed lines, and blocks with a family that none of their lines
    has by itself; lines and blocks whose prediction was not confirmed; families, sorted and joined by commas."""
    spark = docs.sparkSession
    # equal rows have equal results, so 128 bits of a row's hashes know it
    row = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit("row"), "text", "doc_id").alias("b"))
    keyed = docs.select("doc_id", "text", row.alias("row"))
    lines = paragraphs(keyed.select("row", "text"))
    fitted = fit(spark, negatives(lines))
    w = F.col("w")
    candidate = F.struct(_among(F.concat(w, _grams(w, 2)), sorted(fitted["weights"])).alias("grams"), _met(w).alias("g3"))
    # exploding one value keeps the optimizer from writing an expression out at each place that uses it
    likely = (
        lines.select("row", "block", "place", F.explode(F.array(words(F.col("line")))).alias("w"))
        .filter(F.exists("w", lambda x: _in(x, fitted["rarest"])))
        .select("row", "block", "place", F.explode(F.array(candidate)).alias("x"))
        .select("row", "block", "place", "x.grams", "x.g3")
        .filter("size(grams) > 0 or size(g3) > 0")
    )
    likely = materialize(likely.dropDuplicates(["row", "block", "place"]), "likely")
    whole = (
        likely.groupBy("row", "block")
        .agg(F.count("*").alias("n"), *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("grams", "g3")])
        .filter("n > 1")
        .select("row", "block", F.lit(-1).alias("place"), "grams", "g3")
    )
    units = materialize(likely.unionByName(whole), "units")
    scored = score(units.select("row", "block", "place", "grams"), fitted)
    best = F.array_position("p", F.array_max("p")).cast("int")
    chosen = scored.select("row", "block", "place", best.alias("c"), F.array_max("p").alias("probability")).filter(
        (F.col("c") > 1) & (F.col("probability") > F.element_at(F.array(*[F.lit(float(x)) for x in fitted["least"]]), F.col("c")))
    )
    families = F.array(*[F.lit(x) for x in NOTICES])
    cover = chosen.join(units, ["row", "block", "place"]).withColumn("cover", F.explode(F.array(coverage("g3"))))
    own = F.element_at("cover", F.array_position(families, F.col("family")).cast("int"))
    checked = (
        cover.withColumn("family", F.element_at(F.array(*[F.lit(x) for x in fitted["names"]]), F.col("c")))
        .withColumn("confirmed", (own >= COVER) & (own >= F.array_max("cover")))
        .withColumn("named", F.filter(families, lambda f: F.element_at("cover", F.array_position(families, f).cast("int")) == F.array_max("cover")))
        .groupBy("row", "block")
        .agg(
            F.count_if(F.col("confirmed") & (F.col("place") >= 0)).alias("lines"),
            F.count_if(~F.col("confirmed")).alias("others"),
            F.array_distinct(F.flatten(F.collect_list(F.when(F.col("confirmed") & (F.col("place") >= 0), F.col("named"))))).alias("of_lines"),
            F.max(F.when(F.col("confirmed") & (F.col("place") < 0), F.col("family"))).alias("of_block"),
            F.min(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
        )
    )
    more = F.col("of_block").isNotNull() & ~F.array_contains("of_lines", F.col("of_block"))
    named = F.array_compact(F.array_append("of_lines", F.col("of_block")))
    found = checked.groupBy("row").agg(
        F.sum(F.col("lines") + more.cast("int")).alias("n_licensed"),
        F.sum("others").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(named)))), ",").alias("families"),
        F.min("probability").alias("least_probability"),
    )
    lines_of = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0))
    return (
        keyed.select("row", "doc_id", lines_of.cast("bigint").alias("n_paragraphs"))
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_paragraphs",
            F.coalesce("n_licensed", F.lit(0)).cast("bigint").alias("n_licensed"),
            F.coalesce("n_unconfirmed", F.lit(0)).cast("bigint").alias("n_unconfirmed"),
            F.coalesce("families", F.lit("")).alias("families"),
            "least_probability",
        )
    )
