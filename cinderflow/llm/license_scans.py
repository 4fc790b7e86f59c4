"""License scans: a positional index of rare licence words, files' words looked up in it, then key phrases.

The templates are the public wordings of common licences and their notices.

1. A file's words are cut once; of them only licence words (words of templates or phrases) go on, with their places.
2. In how many files each licence word stands is counted over the whole corpus; its IDF follows. Of each file its own LOOKED_UP licence words of the
   highest IDF are looked up: they are words that the file has, so a licence that is cut short, or one whose rarest words are left out, is still found by those that are there.
3. The index holds every place of the templates' words (of five letters or more, where a template has enough of those): (word, template, place). Of a file that has too few words of a template no place is looked up there. The file's words meet the postings by an
   equi-join. Postings of one template agree if their offsets (place in the file less place in the template) differ by less than SLACK: offsets
   are dealt to bins of SLACK, once from 0 and once from SLACK / 2, so words put in or left out do no harm.
4. A bin's share is the IDF of the different words that agree in it over the IDF of all looked-up words that the template has at all, times the part of
   PLACES words (or of all the template has) that agree; with fewer than LEAST_WORDS it is no find. Where a template's best share reaches LEAST_SHARE, the mandatory key phrase must
   stand where that bin expects the template (MARGIN words more on both sides); then the template's label is added. Phrases are looked for in such files only.

The score is the best of all templates, whether verified or not. Base labels come from the places of the base phrases
alone and always stay. Everything is DataFrame functions. Texts are read once; what is written for the second step holds licence words only.

Edge cases
* null or empty text: 0 words, no places, null first and last word, empty labels, score 0.
* a word repeated very often: a row for each of its places that is looked up; in a bin it counts once.
* repeated rows, null doc_ids: each row is scanned and returned by itself. Ties between templates: all that qualify give
  labels; between bins of one template: the one that begins first.
* very long texts: any length that an executor holds as one array of words. No rows: an empty result.
* extra columns, whatever their names, are left out.
"""

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderflow.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of a text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {} for more details."""
_CC = """This work is licensed under the Creative Commons {} 4.0 International License. To view a copy of this license, visit
creativecommons.org or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""
_VERBATIM = """Copyright Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but
changing it is not allowed."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,"""
#: Label, mandatory key phrase and wording of each template.
TEMPLATES = [
    ("gpl", "gnu general public license", _GNU.format(*["General Public License"] * 2)),
    ("lgpl", "lesser general public license", _GNU.format(*["Lesser General Public License"] * 2)),
    ("agpl", "affero general public license", _GNU.format(*["Affero General Public License"] * 2)),
    ("apache", "apache license", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
     License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
     writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
     or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("apache", "apache license", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License"
     shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity
     authorized by the copyright owner that is granting the License."""),
    ("gpl", "gnu general public license", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 """ + _VERBATIM),
    ("lgpl", "lesser general public license", """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 """ + _VERBATIM),
    ("agpl", "affero general public license", """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 """ + _VERBATIM),
    ("lgpl", "lesser general public license", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
     Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
     even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("mit", "to any person obtaining a copy", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
     merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
     subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """ + _AS_IS + """ FITNESS
     FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
     OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd", "source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
     disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
     the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
     derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
     BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
     INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
     HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
     OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", "with or without fee", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
     INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING
     FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("mpl", "mozilla public license", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at mozilla.org"""),
    ("epl", "eclipse public license", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
     which is available at eclipse.org"""),
    ("unlicense", "unencumbered software", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
     publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
     non-commercial, and by any means."""),
    ("zlib", "redistribute it freely", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
     liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
     commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
     wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
     plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("bsl", "person or organization obtaining", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
     and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
     Software, and to prepare derivative works of the Software"""),
    ("cc0", "waived all copyright", """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
     neighboring rights to this work."""),
    ("cc-by", "commons attribution 4", _CC.format("Attribution")),
    ("cc-by-sa", "attribution sharealike", _CC.format("Attribution-ShareAlike")),
    ("cc-by-nc", "attribution noncommercial", _CC.format("Attribution-NonCommercial")),
    ("cc-by-nd", "attribution noderivatives", _CC.format("Attribution-NoDerivatives")),
    ("cc-by-sa", "cc by sa", "CC BY-SA"), ("cc-by-nc", "cc by nc", "CC BY-NC"), ("cc-by-nd", "cc by nd", "CC BY-ND"),
]
#: Highest-IDF licence words of a file that are looked up; letters of a licence word that is in no phrase; offsets that agree; words about a template in which its
#: key phrase may stand; different words that must agree for a full score, and for any; score that asks for the key phrase.
LOOKED_UP, LETTERS, SLACK, MARGIN, PLACES, LEAST_WORDS, LEAST_SHARE = 24, 5, 8, 16, 5, 4, 0.5


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def vocabulary(templates=TEMPLATES) -> list[str]:
    """All licence words: those of phrases, and those that are indexed."""
    phrases = {w for p in [*BASE, *(key for _, key, _ in templates)] for w in p.split()}
    return sorted(phrases | {w for w, *_ in index_rows(templates)})


def index_rows(templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """word, template, place of every indexed word in every template: those of LETTERS letters or more, or all words of a template that has few of those."""
    rows = []
    for t, (*_, text) in enumerate(templates):
        words = words_of(text)
        long = {w for w in words if len(w) >= LETTERS}
        rows += [(w, t, i) for i, w in enumerate(words) if len(long) < PLACES or w in long]
    return rows


def idf(held: int, files: int) -> float:
    return round(math.log(1 + (files + 1) / (held + 1)), 9)


def _places(met, phrase: str):
    """Places in the text at which the phrase begins; met: all licence words (word, at) of the text, which a phrase's words are among."""
    parts = phrase.split()
    same = lambda i, k, w: (F.get(met, i + k)["word"] == w) & (F.get(met, i + k)["at"] == F.get(met, i)["at"] + k)

    def there(i):
        out = same(i, 0, parts[0])
        for k, w in enumerate(parts[1:], 1):
            out = out & same(i, k, w)
        return out

    at = F.filter(F.sequence(F.lit(0), F.size(met) - len(parts)), there)
    return F.when(F.size(met) >= len(parts), F.transform(at, lambda i: F.get(met, i)["at"])).otherwise(F.array().cast("array<int>"))


def read(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """row, doc_id, n_words, met (licence words with their places), base (places by base phrase); written."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select("doc_id", F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0).alias("words"))
    known = vocabulary(templates)
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(known))
    found = F.transform(at, lambda i: F.struct(F.get("words", i).alias("word"), i.alias("at")))
    none = F.array().cast("array<struct<word:string,at:int>>")
    rows = cut.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("words") > 0, found).otherwise(none).alias("met"))
    met = F.col("met")
    told = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "met",
        F.array(*[_places(met, p) for p in BASE]).alias("base"),
    )
    return written(told, "license-words")


def weights(found: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF of every licence word over all files: as many counts reach the driver as there are licence words."""
    counts = found.select(F.explode(F.array_distinct("met.word")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    held, files = {r["word"]: r["n"] for r in counts.collect()}, found.count()
    return {w: idf(held.get(w, 0), files) for w in vocabulary(templates)}


def looked_up(found: DataFrame, idfs: dict[str, float], needs: list[tuple[list[str], int]], most: int = LOOKED_UP) -> DataFrame:
    """row, likely, word, at: the places of each file's licence words of the highest IDF (ties by word), of files that have enough words of a template.

    needs: the different words of each template and how many of them a file must have; likely: the templates of which it has as many.
    """
    table = F.create_map(*[x for w, v in idfs.items() for x in (F.lit(w), F.lit(v))])
    indexed = sorted({w for own, _ in needs for w in own})
    words = F.transform(F.filter(F.array_distinct("met.word"), lambda w: w.isin(indexed)), lambda w: F.struct((-table[w]).alias("minus"), w.alias("word")))
    chosen = found.where(F.size("met") >= 2).select("row", "met", F.transform(F.slice(F.array_sort(words), 1, most), lambda c: c["word"]).alias("chosen"))
    enough = [F.when(F.size(F.array_intersect("chosen", F.array(*map(F.lit, own)))) >= need, k) for k, (own, need) in enumerate(needs)]
    # The generator of one row has the lists made once, before the filter.
    told = chosen.select("row", "met", "chosen", F.explode(F.array(F.filter(F.array(*enough), lambda k: k.isNotNull()))).alias("likely")).where(F.size("likely") > 0)
    kept = told.select("row", "likely", F.explode(F.filter("met", lambda m: F.array_contains("chosen", m["word"]))).alias("m"))
    return kept.select("row", "likely", F.col("m.word").alias("word"), F.col("m.at").alias("at"))


def best_bins(found: DataFrame, idfs: dict[str, float], templates=TEMPLATES, slack: int = SLACK) -> DataFrame:
    """row, template, share, low: for each file and template with enough words at one offset, the best share and where its bin begins.

    Enough: LEAST_WORDS, or all that the template has, if fewer.
    """
    spark, rows = found.sparkSession, index_rows(templates)
    # As many rows as the templates have words: some thousands, whatever the files.
    postings = F.broadcast(spark.createDataFrame([(*r, idfs[r[0]]) for r in rows], "word string, template int, place int, idf double"))
    own = [sorted({w for w, t, _ in rows if t == k}) for k in range(len(templates))]
    need, least = ([min(n, len(words)) for words in own] for n in (PLACES, LEAST_WORDS))
    half = slack // 2
    met = looked_up(found, idfs, list(zip(own, least, strict=True))).join(postings, "word").where(F.array_contains("likely", F.col("template"))).drop("likely")
    # What the file's words could add up to in a template at most, each word once.
    possible = met.groupBy("row", "template", "word").agg(F.first("idf").alias("idf")).groupBy("row", "template").agg(F.sum("idf").alias("all"))
    low = lambda shift: F.floor((F.col("at") - F.col("place") + shift) / slack).cast("int") * slack - shift
    binned = met.select("row", "template", "word", "idf", F.explode(F.array_distinct(F.array(low(0), low(half)))).alias("low"))
    words = binned.groupBy("row", "template", "low", "word").agg(F.first("idf").alias("idf"))
    by = words.groupBy("row", "template", "low").agg(F.sum("idf").alias("idf"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.get(F.array(*map(F.lit, least)), F.col("template"))).join(possible, ["row", "template"])
    share = F.col("idf") / F.col("all") * F.least(F.lit(1.0), F.col("n") / F.get(F.array(*map(F.lit, need)), F.col("template")))
    top = by.groupBy("row", "template").agg(F.max(F.struct(F.round(share, 9).alias("share"), (-F.col("low")).alias("before"))).alias("b"))
    return top.select("row", "template", F.col("b.share").alias("share"), (-F.col("b.before")).alias("low"))


def _between(low, high):
    return lambda p: p.between(low, high)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = read(docs, templates)
    best = best_bins(found, weights(found, templates), templates).groupBy("row").agg(F.collect_list(F.struct("template", "share", "low")).alias("best"))
    rows = found.join(best, "row", "left")
    lengths = [len(words_of(t[2])) for t in templates]
    label = F.array(*[F.lit(t[0]) for t in templates])

    def stands(b):
        """Whether the key phrase stands where the bin expects its template; only the template's own phrase is looked for."""
        out = F.lit(False)
        for k, (_, key, _) in enumerate(templates):
            end = b["low"] + lengths[k] + MARGIN
            near = F.exists(_places(F.col("met"), key), _between(b["low"] - MARGIN, end))
            out = F.when(b["template"] == k, near).otherwise(out)
        return out

    likely = F.filter("best", lambda b: b["share"] >= LEAST_SHARE)
    verified = F.filter(likely, stands)
    added = F.coalesce(F.transform(verified, lambda b: F.get(label, b["template"])), F.array().cast("array<string>"))
    base = F.filter(F.array(*[F.when(F.size(F.get("base", F.lit(i))) > 0, name) for i, name in enumerate(BASE.values())]), lambda x: x.isNotNull())
    places = F.flatten("base")
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return rows.select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(F.concat(base, added)).alias("labels"), F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("best", lambda b: b["share"])), F.lit(0.0))).alias("score"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_license_scans": op10_license_scans}
ORACLE_SQL = {}
