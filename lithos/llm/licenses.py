"""Licence notices by Dice's coefficient over word bigrams, with built-in functions only.

A text's word bigrams are matched with those of the templates (a fixed list, so broadcast). By the size
bound a text at the threshold t has t / (2 - t) of a template's bigrams at least, so of any set of more
than the rest it has one: texts that have none of such a set of any template (the longest, which prose
shares least) go before anything is exploded or shuffled, and so do, before windows are compared, the
templates of which a stretch has too few. Matched bigrams of a template that stand close together form a stretch, which is compared: twice the bigrams
in common, counted with repetition, over the bigrams of both. A stretch may hold a notice between words
it shares with prose, or several notices in a row, so each of its windows from a matched bigram to
another is compared, but for those that the matched bigram next to an end improves. Of windows that
overlap the best stays, then the longest, then the first by name; this is repeated for those that
overlap none that stays.

The SQL knows whole stretches only, so it says the same wherever no part of a stretch is better.

Words are runs of ASCII letters and digits in lower case. Null and empty texts have none, very long
ones are scanned whole. Rows that repeat a doc_id and a text give one result; a null doc_id is a value
like any other. An empty table gives an empty result. Only doc_id and text are read, whatever other
columns are named.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Texts of licence notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_WORDS = {k: [w for w in re.split("[^a-z0-9]+", v.lower()) if w] for k, v in TEMPLATES.items()}
#: Bigrams of the longest template; the most often that a template repeats one.
LONGEST = max(len(w) - 1 for w in _WORDS.values())
MOST = max(max(Counter(zip(w, w[1:])).values()) for w in _WORDS.values())


def distinctive(threshold: float) -> list[str]:
    """Bigrams of which a text at the threshold has one for some template: of each template so many,
    counted with repetition, that the rest are too few."""
    out: set[str] = set()
    for w in _WORDS.values():
        times = Counter(f"{a} {b}" for a, b in zip(w, w[1:]))
        rest, needed = len(w) - 1, (len(w) - 1) * threshold / (2 - threshold) - 1e-9
        for bigram in sorted(times, key=lambda b: (-len(b), b)):
            if rest < needed:
                break
            out.add(bigram)
            rest -= times[bigram]
    return sorted(out)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def bigrams(of: Column) -> Column:
    """Neighbouring words of an array, with a space between; empty below two words. The array is computed
    once: a column named inside a lambda would be computed anew for each element."""
    def pairs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat(F.element_at(w, i), F.lit(" "), F.element_at(w, i + 1)))
        return F.when(F.size(w) > 1, each).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(of), pairs), 1)


def templates(spark: SparkSession) -> DataFrame:
    """license, size (bigrams), gap (unmatched bigrams a stretch may hold at a place)."""
    rows = spark.createDataFrame(list(TEMPLATES.items()), "license string, text string").select("license", bigrams(words(F.col("text"))).alias("bigrams"))
    rows = rows.select("license", "bigrams").withColumn("size", F.size("bigrams"))
    return rows.withColumn("gap", F.greatest(F.lit(3), F.floor(F.col("size") / 5)).cast("int"))


def notices(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, start_word, end_word (exclusive) of each notice."""
    spark = documents.sparkSession
    known = templates(spark)
    wanted = known.select("license", F.explode("bigrams").alias("bigram")).groupBy("license", "bigram").agg(F.count("*").alias("times"))
    wanted = wanted.join(known.select("license", "size", "gap"), "license")
    texts = documents.select("doc_id", F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, 16).alias("node"), bigrams(words(F.col("text"))).alias("bigrams"))
    # The outer form: for the inner one Spark tests the array's size first, in a filter that computes it once more.
    telling = F.arrays_overlap("bigrams", F.array(*[F.lit(b) for b in distinctive(threshold)]))
    pairs = texts.filter(telling).select("doc_id", "node", F.posexplode_outer("bigrams").alias("at", "bigram"))
    hits = pairs.join(F.broadcast(wanted), "bigram").distinct()

    place = Window.partitionBy("doc_id", "node", "license").orderBy("at")
    far = F.col("at") - F.lag("at").over(place) > F.col("gap") + 1
    hits = hits.withColumn("far", F.coalesce(far, F.lit(True)).cast("int")).withColumn("stretch", F.sum("far").over(place))
    whole = Window.partitionBy("doc_id", "node", "license", "stretch")
    # Of b bigrams, all in common, the coefficient is at most 2 b / (b + size).
    hits = hits.withColumn("hits", F.count("*").over(whole)).filter(F.col("hits") * (2 - threshold) >= F.col("size") * threshold - 1e-9)

    # The occurrences of the bigram that stand `times` before and after: in a window from a to z, one counts if `before` stands before a.
    same = Window.partitionBy("doc_id", "node", "license", "stretch", "bigram").orderBy("at")
    earlier, later = (F.collect_list("at").over(same.rowsBetween(*rows)) for rows in ((-MOST, -1), (1, MOST)))
    hits = hits.withColumn("earlier", earlier).withColumn("later", later)
    hits = hits.withColumn("before", F.get("earlier", (F.size("earlier") - F.col("times")).cast("int"))).withColumn("after", F.get("later", (F.col("times") - 1).cast("int"))).drop("earlier", "later")

    along = whole.orderBy("at")
    ahead = F.collect_list(F.struct("at", "before")).over(along.rangeBetween(0, int(LONGEST * (2 - threshold) / threshold) + 1))
    cut = hits.withColumn("ahead", ahead).withColumn("joined", F.lag("at").over(along) == F.col("at") - 1).withColumn("lost", F.lag("after").over(along))
    cut = cut.withColumn("ahead", F.filter("ahead", lambda h: h["before"].isNull() | (h["before"] < F.col("at"))))

    def window(h: Column, i: Column) -> Column:
        length = h["at"] - F.col("at") + 1
        follows = F.coalesce(F.get(F.col("ahead"), i + 1)["at"] == h["at"] + 1, F.lit(False))
        leads = F.coalesce(F.col("joined"), F.lit(False)) & F.coalesce(F.col("lost") > h["at"], F.lit(True))
        return F.struct((2 * (i + 1) / (length + F.col("size"))).alias("dice"), length.alias("length"), F.col("at").alias("first"), h["at"].alias("last"), (follows | leads).alias("grows"))

    cut = cut.withColumn("windows", F.filter(F.transform("ahead", window), lambda w: (w["dice"] >= threshold) & ~w["grows"])).select("doc_id", "node", "license", F.explode("windows").alias("window"))
    found = cut.select("doc_id", "node", "license", "window.dice", "window.length", "window.first", "window.last")

    ranked = F.sort_array(F.collect_list(F.struct((-F.col("dice")).alias("less"), (-F.col("length")).alias("shorter"), "license", "first", "last", "dice")))
    found = found.groupBy("doc_id", "node").agg(ranked.alias("ranked"))
    taken = lambda kept, w: F.exists(kept, lambda k: (k["first"] <= w["last"]) & (w["first"] <= k["last"]))
    best = F.aggregate("ranked", F.slice("ranked", 1, 0), lambda kept, w: F.when(taken(kept, w), kept).otherwise(F.concat(kept, F.array(w))))
    found = found.select("doc_id", F.explode(best).alias("best"))
    return found.select("doc_id", "best.license", "best.dice", F.col("best.first").cast("long").alias("start_word"), (F.col("best.last") + 2).cast("long").alias("end_word"))


def oracle() -> str:
    """The same for DuckDB."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    return rf"""
WITH t0 AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (VALUES {values}) v(license, text)),
tb AS (SELECT license, len(w) - 1 AS size, w[i] || ' ' || w[i + 1] AS bigram FROM t0, unnest(range(1, len(w))) u(i)),
t AS (SELECT license, bigram, any_value(size) AS size, count(*) AS times FROM tb GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT doc_id, md5(text) AS node, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT doc_id, node, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS bigram FROM dw, unnest(range(1, len(w))) u(i)),
h AS (SELECT *, greatest(3, size // 5) AS gap FROM p JOIN t USING (bigram)),
f AS (SELECT *, CASE WHEN pos - lag(pos) OVER q <= gap + 1 THEN 0 ELSE 1 END AS far FROM h WINDOW q AS (PARTITION BY doc_id, node, license ORDER BY pos)),
s AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, node, license ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stretch FROM f),
c AS (SELECT doc_id, node, license, size, stretch, bigram, least(count(*), any_value(times)) AS common, min(pos) AS a, max(pos) AS z FROM s GROUP BY ALL),
g AS (SELECT doc_id, node, license, size, stretch, sum(common) AS common, min(a) AS a, max(z) AS z FROM (SELECT * FROM c) GROUP BY doc_id, node, license, size, stretch),
e AS (SELECT *, z - a + 1 AS length, 2 * common / (z - a + 1 + size) AS dice FROM g),
k AS (SELECT * FROM e WHERE dice >= {THRESHOLD}),
n AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY doc_id, node ORDER BY a, z, license ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM k),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, node ORDER BY a, z, license ROWS UNBOUNDED PRECEDING) AS place FROM n)
SELECT doc_id, license, dice::DOUBLE AS dice, a::BIGINT AS start_word, (z + 2)::BIGINT AS end_word
FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, node, place ORDER BY dice DESC, length DESC, license) = 1
"""
