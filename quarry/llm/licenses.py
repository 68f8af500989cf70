"""License scans: templates found in overlapping windows of texts, with DataFrame functions only.

A template of m words is sought in windows of m + s - 1 words, s apart, s being a quarter of its runs of five words, so
that some window holds any occurrence whole and is of similarity 0.55 at least to a template of which it holds four
fifths. A window's MinHash of BANDS bands of one value each shares a band with such a template with a probability of
1 - 0.45 ** BANDS at least (0.999997 for 16). Windows that share a band are compared exactly: the share of the
template's distinct runs of five words that the window holds.

A window shares a band's value with a template only if it holds the very run whose hash is the template's least in
that band. So the look-up of the bands starts from those runs, at most BANDS of each template: where a text has one,
the windows around it are signed and their band values joined with the templates'. Windows without such a run have
other values in every band; leaving them unsigned is the same join, without its misses. Templates are a small table; it
is measured before it is broadcast, and beyond the bound the joins shuffle.

A template of fewer than five words is one run of all its words, and texts are cut into runs of its width for it.

Every row is scanned under a key of its own and gives its own matches, with a null id or a repeated one as well. Null
and empty texts match nothing, nor do templates without words; empty tables give no rows. Other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded, drop, keyed, staged
from quarry.llm.contamination import lowered, words

WIDTH, BANDS, CONTAINED = 5, 16, 0.8

#: Words of short templates up to which texts without any of them are passed over before they are cut into runs.
FEW = 64

#: Notices, headers, texts and identifiers of common licenses (fixed values: the licenses' own published wording).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "all-rights-reserved-line": "All rights reserved.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-ISC": "SPDX-License-Identifier: ISC",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-LGPL-2.1": "SPDX-License-Identifier: LGPL-2.1",
    "SPDX-AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0",
    "SPDX-BSD-2-Clause": "SPDX-License-Identifier: BSD-2-Clause",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((texts or TEMPLATES).items()), "license string, text string")


def runs(w: str, width: int = WIDTH) -> Column:
    """A hash of every run of width words, in order."""
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))).otherwise(F.array().cast("array<bigint>"))


def bands(own: Column) -> Column:
    """The least value of each of BANDS hashes of the runs, and the run that has it."""

    def hashed(b: int):
        return lambda h: F.struct(F.xxhash64(h, F.lit(b)).alias("value"), h.alias("run"))

    return F.array(*[F.array_min(F.transform(own, hashed(b))) for b in range(BANDS)])


def scan(df: DataFrame, table: DataFrame, id: str = "doc_id", text: str = "text", license: str = "license", license_text: str = "text") -> DataFrame:
    """(id, license, n_windows, containment, first_word): for each row and template how many windows hold the
    template's runs to a share of CONTAINED at least, the greatest share, and where the first such window starts."""
    rows = keyed(df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), "texts")
    docs = rows.select("row_key", words("text").alias("w"))
    given = table.select(F.col(license).alias("license"), words(license_text).alias("w")).where(F.size("w") > 0)
    wide = given.where(F.size("w") >= WIDTH).select("license", F.size("w").alias("m"), F.array_distinct(runs("w")).alias("own"))
    stride = F.greatest(F.lit(1), F.floor((F.col("m") - (WIDTH - 1)) / 4)).cast("int")
    # held: runs in a window
    known = staged(wide.withColumn("stride", stride).withColumn("held", F.col("m") + F.col("stride") - WIDTH).drop("m"), "templates")
    of_band = staged(known.select("license", "stride", "held", F.posexplode(bands(F.col("own"))).alias("band", "x")).select("license", "stride", "held", "band", "x.*"), "bands")

    anchors, _ = bounded(of_band.select("stride", "held", "run").distinct())
    hits = docs.select("row_key", F.posexplode(runs("w")).alias("pos", "run")).join(anchors, "run")
    lowest = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("held") + 1) / F.col("stride"))).cast("int")
    around = F.sequence(lowest, F.floor(F.col("pos") / F.col("stride")).cast("int"))
    windows = staged(hits.select("row_key", "stride", "held", F.explode(F.filter(around, lambda k: k >= 0)).alias("k")).distinct(), "windows")

    found, _ = bounded(windows.select("row_key").distinct())
    held = docs.join(found, "row_key", "left_semi").select("row_key", runs("w").alias("runs")).join(windows, "row_key")
    held = held.select("row_key", "stride", "held", "k", F.slice("runs", F.col("k") * F.col("stride") + 1, F.col("held")).alias("runs"))
    signed = held.select("*", F.posexplode(bands(F.col("runs"))).alias("band", "x")).withColumn("value", F.col("x.value"))
    values, _ = bounded(of_band.select("license", "stride", "held", "band", "value"))
    met = signed.join(values, ["stride", "held", "band", "value"]).select("row_key", "license", (F.col("k") * F.col("stride")).alias("at"), "runs")
    checked = met.join(bounded(known.select("license", "own"))[0], "license")
    share = F.size(F.array_intersect("runs", "own")) / F.size("own")
    good = checked.select("row_key", "license", "at", share.alias("share")).where(F.col("share") >= CONTAINED).distinct()
    out = good.groupBy("row_key", "license").agg(F.count("*").alias("n_windows"), F.round(F.max("share"), 6).alias("containment"), F.min("at").cast("long").alias("first_word"))
    out = staged(out.unionByName(_short(rows, given.where(F.size("w") < WIDTH))), "matches")
    drop(windows, known, of_band)
    return rows.select("row_key", F.col("id").alias(id)).join(bounded(out)[0], "row_key").drop("row_key")


def _short(rows: DataFrame, given: DataFrame) -> DataFrame:
    """The same for templates of fewer than WIDTH words, each one run: a window is the run itself."""
    short = staged(given.select("license", F.size("w").alias("m"), F.xxhash64("w").alias("run"), F.array_max(F.transform("w", lambda x: F.struct(F.length(x), x.alias("x"))))["x"].alias("longest")), "short")
    known = [r["longest"] for r in short.select("longest").distinct().limit(FEW + 1).collect()]
    if len(known) <= FEW:  # a text without the longest word of any has none of them
        low, some = lowered("text"), F.lit(False)
        for word in known:
            some = some | low.contains(word)
        rows = rows.where(some)
    docs, at = rows.select("row_key", words("text").alias("w")), None
    for m in range(1, WIDTH):
        own, _ = bounded(short.where(F.col("m") == m).select("license", "run"))
        here = docs.select("row_key", F.posexplode(runs("w", m)).alias("at", "run")).join(own, "run").select("row_key", "license", "at")
        at = here if at is None else at.unionByName(here)
    found = at.distinct().groupBy("row_key", "license")
    return found.agg(F.count("*").alias("n_windows"), F.lit(1.0).alias("containment"), F.min("at").cast("long").alias("first_word"))
