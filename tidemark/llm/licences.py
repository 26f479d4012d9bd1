"""Licence scans: passages of a text compared with licence templates by Dice coefficient over word bigrams.

Everything is DataFrame expressions. A text is normalised to its words, letters A-Z and digits in lower case, so line ends,
blank lines, comment marks and signs are nothing. Neighbouring words make bigrams. Where bigrams of one template stand
close together, they and what is between them are a passage, which is compared with the template:
2c / (n + m) for ``c`` distinct bigrams in common, ``n`` in the passage and ``m`` in the template. It can reach the
threshold t only where c >= t / (2 - t) m and n <= (2 - t) / t m, so most texts and passages go before any comparison.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

THRESHOLD = 0.75
#: Bigrams between two of a template in one passage: an eighth of the template's number, 8 at most and 1 at least.
MOST_BETWEEN = 8

# Wordings of public licences and of the notices that name them.
TEMPLATES = [
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Released under the BSD License."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def _words(text):
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _bigrams(text):
    """The bigrams of a text in order; the array of words is bound once."""
    rest = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return F.transform(F.array(_words(text)), lambda w: F.zip_with(F.slice(w, 1, rest(w)), F.slice(w, 2, rest(w)), lambda a, b: F.concat(a, F.lit(" "), b)))[0]


def template_bigrams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, licence, m, between, bigram``: a row for each distinct bigram of each template."""
    texts = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, text string")
    each = texts.select("template", "licence", F.explode(_bigrams("text")).alias("bigram")).distinct()
    sized = each.withColumn("m", F.count("*").over(Window.partitionBy("template")).cast("int"))
    return sized.withColumn("between", F.greatest(F.lit(1), F.least(F.lit(MOST_BETWEEN), F.floor(F.col("m") / 8))).cast("int"))


def scan_licences(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``doc_id, licence, first_word, n_words, dice``: the passages of ``docs(doc_id, text, ...)`` that match a template.

    Of passages that overlap, one after another, the one with most bigrams in common is returned (ties: the greater
    coefficient, the licence first in the alphabet, the earlier template). Null, empty and wordless texts match
    nothing; rows without doc_id are found under a null id; rows that repeat an id with the same text count
    once, with other texts each for itself; an empty table gives no rows; other columns are ignored. The
    templates are broadcast: their number is fixed by the caller, not by the data.
    """
    known = template_bigrams(docs.sparkSession, templates)
    share = threshold / (2 - threshold)
    by_template = known.groupBy("template").agg(F.first("m").alias("m"), F.collect_list("bigram").alias("bigrams")).orderBy("template").collect()
    # bigrams hold letters, digits and a blank
    listed = lambda bigrams: f"in ({', '.join(repr(x) for x in sorted(bigrams)) or repr('')})"
    is_known = listed({x for r in by_template for x in r.bigrams})
    likely = " or ".join(f"size(filter(h, x -> x {listed(r.bigrams)})) >= {ceil(share * r.m)}" for r in by_template) or "false"
    keys = ["doc_id", "version"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    grams = texts.select("doc_id", F.xxhash64("text").alias("version"), _bigrams("text").alias("grams"))
    # texts go before anything is exploded or written unless some template finds enough of its bigrams in them
    found = f"array_distinct(filter(grams, x -> x {is_known}))"
    some = staged(grams.where(F.expr(f"exists(array({found}), h -> {likely})")).dropDuplicates(keys), "licences")
    places = F.expr(f"filter(transform(grams, (x, i) -> struct(i as place, x as bigram)), s -> s.bigram {is_known})")
    hits = some.select(*keys, F.inline(places)).join(F.broadcast(known), "bigram")
    of_template = ["doc_id", "version", "template", "licence", "m"]
    order = Window.partitionBy("doc_id", "version", "template").orderBy("place")
    opens = F.coalesce(F.col("place") - F.lag("place").over(order) > F.col("between") + 1, F.lit(True))
    numbered = hits.withColumn("opens", opens.cast("int")).withColumn("passage", F.sum("opens").over(order))
    passages = numbered.groupBy(*of_template, "passage").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.count_distinct("bigram").alias("c")
    ).where(F.col("c") >= share * F.col("m"))
    p, g = passages.alias("p"), some.alias("g")
    both = p.join(g, F.col("p.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("p.version") == F.col("g.version"))).select("p.*", "g.grams")
    sized = both.withColumn("n", F.size(F.array_distinct(F.slice("grams", F.col("first") + 1, F.col("last") - F.col("first") + 1)))).drop("grams")
    dice = sized.withColumn("dice", F.round(2.0 * F.col("c") / (F.col("n") + F.col("m")), 6)).where(F.col("dice") >= threshold)
    by_place = Window.partitionBy(*keys).orderBy("first", "last", "template")
    before = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    groups = dice.withColumn("opens", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("group", F.sum("opens").over(by_place))
    best = Window.partitionBy(*keys, "group").orderBy(F.desc("c"), F.desc("dice"), "licence", "template", "first")
    return (
        groups.withColumn("rank", F.row_number().over(best)).where("rank = 1")
        .select("doc_id", "licence", F.col("first").cast("long").alias("first_word"), (F.col("last") - F.col("first") + 2).cast("long").alias("n_words"), "dice")
    )


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Written from the definition: every bigram of every text is laid out and compared.
ORACLE_SQL = f"""
with templates(template, licence, text) as (values {', '.join(f'({k}, {_quoted(name)}, {_quoted(text)})' for k, (name, text) in enumerate(TEMPLATES))}),
ids as (select row_number() over () as id, doc_id, text from (select distinct doc_id, text from documents where text is not null)),
split as (
  select 't' as kind, cast(template as bigint) as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from templates
  union all select 'd', id, regexp_extract_all(lower(text), '[a-z0-9]+') from ids
),
placed as (select kind, id, unnest(range(len(w) - 1)) as place, w from split where len(w) > 1),
grams as (select kind, id, place, w[place + 1] || ' ' || w[place + 2] as bigram from placed),
known as (select distinct id as template, bigram from grams where kind = 't'),
sizes as (select template, licence, m, greatest(1, least({MOST_BETWEEN}, m // 8)) as between_ from templates join (select template, count(*) as m from known group by 1) using (template)),
hits as (select g.id, k.template, g.place, g.bigram from grams g join known k using (bigram) where g.kind = 'd'),
steps as (select *, place - lag(place) over (partition by id, template order by place) as step from hits),
numbered as (
  select s.*, z.licence, z.m, sum(case when step <= between_ + 1 then 0 else 1 end) over (partition by s.id, s.template order by place) as passage
  from steps s join sizes z using (template)
),
passages as (select id, template, licence, m, passage, min(place) as first_, max(place) as last_, count(distinct bigram) as c from numbered group by all),
large as (select * from passages where 2 * c >= {THRESHOLD} * (c + m)),
sized as (
  select p.id, p.template, licence, m, first_, last_, c, count(distinct g.bigram) as n
  from large p join grams g on g.kind = 'd' and g.id = p.id and g.place between first_ and last_ group by all
),
scored as (select *, round(2.0 * c / (n + m), 6) as dice from sized),
matched as (select *, max(last_) over (partition by id order by first_, last_, template rows between unbounded preceding and 1 preceding) as before_ from scored where dice >= {THRESHOLD}),
grouped as (select *, sum(case when first_ <= before_ + 1 then 0 else 1 end) over (partition by id order by first_, last_, template) as g from matched)
select doc_id, licence, cast(first_ as bigint) as first_word, cast(last_ - first_ + 2 as bigint) as n_words, cast(dice as double) as dice
from grouped join ids using (id)
qualify row_number() over (partition by id, g order by c desc, dice desc, licence, template, first_) = 1
"""
