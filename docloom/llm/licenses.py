"""Licence recognition: known sentences give identifiers, and rules are identifiers that have to occur in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: normalised sentences of public licence texts and notices (A-Z lower-cased, all but a-z and 0-9 one space).
SENTENCES = {
    "apache2.notice": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "released under the apache license 2 0"],
    "apache2.may_not": ["you may not use this file except in compliance with the license", "you may not use this work except in compliance with the license"],
    "apache2.obtain": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache2.as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2.see": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit.notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"],
    "mit.grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit.include": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit.as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit.liability": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "isc.grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "isc.grant0": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc.disclaim": ["the software is provided as is and isc disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd.grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd.notice": ["licensed under the bsd license", "released under the bsd license", "licensed under the bsd 3 clause license", "released under the bsd 3 clause license"],
    "apache2.obtain_as_is": [f"you may obtain a copy of the license at {p} www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied" for p in ("http", "https")],
    "gpl.free": ["this program is free software"],
    "gpl.later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.later": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl.terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl.either": ["either version 3 of the license or at your option any later version"],
    "gpl2.either": ["either version 2 of the license or at your option any later version"],
    "gpl.useful": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "gpl.implied": ["without even the implied warranty of merchantability or fitness for a particular purpose"],
    "mpl.form": ["this source code form is subject to the terms of the mozilla public license v"],
    "mpl.copy": [f"if a copy of the mpl was not distributed with this file you can obtain one at {p} mozilla org mpl 2 0" for p in ("http", "https")],
    "gpl.redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2.redistribute": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl.hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.details": ["see the gnu general public license for more details"],
    "gpl3.notice": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "licensed under the gnu gpl version 3"],
    "gpl2.notice": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "lgpl.notice": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "agpl.notice": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "mpl.notice": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "unlicense.domain": ["this is free and unencumbered software released into the public domain"],
    "unlicense.anyone": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0.notice": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0", "released under cc0 1 0"],
    "ccby.notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa.notice": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccbync.notice": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "zlib.as_is": ["this software is provided as is without any express or implied warranty"],
    "zlib.grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
}
#: A licence and the identifiers that have to occur in this order, others between them or not.
RULES = [
    ("Apache-2.0", "text", ["apache2.notice", "apache2.may_not", "apache2.obtain", "apache2.as_is", "apache2.see"]),
    ("Apache-2.0", "text", ["apache2.notice", "apache2.may_not", "apache2.obtain_as_is", "apache2.see"]),
    ("Apache-2.0", "notice", ["apache2.notice"]),
    ("MIT", "text", ["mit.grant", "mit.include", "mit.as_is", "mit.liability"]),
    ("MIT", "notice", ["mit.notice"]),
    ("ISC", "text", ["isc.grant", "isc.disclaim"]),
    ("0BSD", "text", ["isc.grant0", "isc.disclaim"]),
    ("BSD-3-Clause", "text", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", "text", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", "notice", ["bsd.notice"]),
    ("GPL-3.0-or-later", "text", ["gpl.redistribute", "gpl.hope", "gpl.details"]),
    ("GPL-2.0-or-later", "text", ["gpl2.redistribute", "gpl.hope", "gpl.details"]),
    ("GPL-3.0-or-later", "text", ["gpl.free", "gpl.later", "gpl.useful", "gpl.implied", "gpl.details"]),
    ("GPL-3.0-or-later", "text", ["gpl.free", "gpl.terms", "gpl.either", "gpl.useful", "gpl.implied", "gpl.details"]),
    ("GPL-2.0-or-later", "text", ["gpl.free", "gpl2.later", "gpl.useful", "gpl.implied", "gpl.details"]),
    ("GPL-2.0-or-later", "text", ["gpl.free", "gpl.terms", "gpl2.either", "gpl.useful", "gpl.implied", "gpl.details"]),
    ("GPL-3.0-only", "notice", ["gpl3.notice"]),
    ("GPL-2.0-only", "notice", ["gpl2.notice"]),
    ("LGPL-3.0-only", "notice", ["lgpl.notice"]),
    ("AGPL-3.0-only", "notice", ["agpl.notice"]),
    ("MPL-2.0", "text", ["mpl.form", "mpl.copy"]),
    ("MPL-2.0", "notice", ["mpl.notice"]),
    ("Unlicense", "text", ["unlicense.domain", "unlicense.anyone"]),
    ("CC0-1.0", "notice", ["cc0.notice"]),
    ("CC-BY-4.0", "notice", ["ccby.notice"]),
    ("CC-BY-SA-4.0", "notice", ["ccbysa.notice"]),
    ("CC-BY-NC-4.0", "notice", ["ccbync.notice"]),
    ("Zlib", "text", ["zlib.as_is", "zlib.grant"]),
]
#: Every known sentence holds one of these, so other sentences need no look-up.
ANCHORS = "licen|permi|redistribut|warrant|public domain|cc0|cc by|neither the name|in no event|free to copy|free software|mpl"

#: A line that belongs to no sentence: one without letters and digits, a line of copyright, or the reservation of rights.
BREAK = r"^[^a-z0-9]*$|^[^a-z0-9]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{]|by )|\(c\)[ \t]*[0-9]|©|all rights reserved[^a-z0-9]*$)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A mark that ends a sentence, and the white space behind it.
END = r"([.!?:;])[ \t\n\x0B\f\r]+"


def _identifiers(sentences: Column) -> Column:
    """The identifiers of an array of raw sentences, in their order, as |a||b|."""
    known = F.create_map(*(F.lit(x) for name, forms in SENTENCES.items() for form in forms for x in (form, name)))
    plain = lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "))  # noqa: E731
    near = F.filter(F.transform(sentences, plain), lambda s: s.rlike(ANCHORS))
    found = F.filter(F.transform(near, lambda s: F.try_element_at(known, s)), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.concat(F.lit("|"), F.array_join(found, "||"), F.lit("|"))).otherwise("")


def _holds(ids: Column, rule: list[str]) -> Column:
    return ids.like("%" + "%".join(f"|{x}|" for x in rule) + "%")


def _within(short: list[str], long: list[str]) -> bool:
    """All of short occur in long, in this order."""
    rest = iter(long)
    return all(x in rest for x in short)


#: For each rule, the longer ones that hold wherever it is a part of them: where one of these holds, it says no more.
STRONGER = [[j for j, (_, _, long) in enumerate(RULES) if len(long) > len(short) and _within(short, long)] for _, _, short in RULES]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids (joined by commas), n_sentences and licenses (sorted, each once, joined by commas).

    A text is cut into sentences twice: by lines, at line ends and after . ! ? : ; before white space; and by paragraphs,
    where a sentence may run over lines: empty lines (but for comment marks) and lines of copyright part paragraphs, the same
    marks sentences. A rule has to hold in one of the two orders; one that is a part of another that holds isn't named, as the
    two-clause BSD licence within the three-clause one. sentence_ids are those of the lines, or of the paragraphs where the
    lines have fewer. A match is named licence:text for a rule of a whole licence text or file header and licence:notice for
    one of a short notice. Null and empty texts: no sentences and no licences. Rows stay apart; other columns of docs stay,
    but those named as the new ones. One pass, no shuffle.
    """
    new = ["sentence_ids", "n_sentences", "licenses", "__a", "__b", "__held"]
    rest = [c for c in docs.columns if c.lower() not in new]
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    lines = F.split(F.regexp_replace(text, END, "$1\n"), "\n")
    joined = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike(BREAK), "\n").otherwise(line)), " ")
    paragraphs = F.split(F.regexp_replace(joined, END, "$1\n"), "\n")
    likely = text.rlike(ANCHORS.replace(" ", "[^a-z0-9]+"))
    some = docs.select(*rest, F.when(likely, _identifiers(lines)).otherwise("").alias("__a"), F.when(likely, _identifiers(paragraphs)).otherwise("").alias("__b"))
    n = lambda c: F.regexp_count(c, F.lit(r"\|[^|]+\|"))  # noqa: E731
    more = F.when(n(F.col("__b")) > n(F.col("__a")), F.col("__b")).otherwise(F.col("__a"))
    held = some.withColumn("__held", F.when((F.col("__a") != "") | (F.col("__b") != ""), F.array(*(_holds(F.col("__a"), rule) | _holds(F.col("__b"), rule) for _, _, rule in RULES))))
    own = [F.get("__held", F.lit(i)) & ~F.exists(F.array(*(F.get("__held", F.lit(j)) for j in above)), lambda x: x) if above else F.get("__held", F.lit(i)) for i, above in enumerate(STRONGER)]
    named = F.filter(F.array(*(F.when(x, F.lit(f"{name}:{kind}")) for x, (name, kind, _) in zip(own, RULES))), lambda x: x.isNotNull())
    licenses = F.when(F.col("__held").isNull(), "").otherwise(F.array_join(F.array_sort(F.array_distinct(named)), ","))
    return held.select(*rest, F.replace(F.btrim(more, F.lit("|")), F.lit("||"), F.lit(",")).alias("sentence_ids"), n(more).cast("long").alias("n_sentences"), licenses.alias("licenses"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL, for doc_id, said by rows: lines numbered in their paragraphs, and sentences joined with the known ones."""
    known = ", ".join(f"('{form}', '{name}')" for name, forms in SENTENCES.items() for form in forms)
    rules = ", ".join(f"({k}, '{name}:{kind}', '%{'%'.join(f'|{x}|' for x in rule)}%')" for k, (name, kind, rule) in enumerate(RULES))
    blank = BREAK.replace("'", "''")
    return rf"""
WITH known(form, name) AS (VALUES {known}),
rules(k, title, chain) AS (VALUES {rules}),
base AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM {table}),
lines AS (SELECT r, unnest(range(len(s))) AS i, unnest(s) AS l FROM (SELECT r, string_split(t, chr(10)) AS s FROM base)),
parts AS (SELECT r, i, l, gap, sum(gap) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT *, CAST(regexp_matches(l, '{blank}') AS INT) AS gap FROM lines)),
units AS (SELECT r, 'lines' AS way, i AS p, l AS t FROM lines
          UNION ALL SELECT r, 'paragraphs', p, string_agg(l, ' ' ORDER BY i) FROM parts WHERE gap = 0 GROUP BY r, p),
cut AS (SELECT r, way, p, unnest(range(len(s))) AS j, unnest(s) AS x FROM (SELECT r, way, p, string_split_regex(regexp_replace(t, '([.!?:;])[ 	

]+', '' || chr(10), 'g'), '
') AS s FROM units)),
found AS (SELECT r, way, name, row_number() OVER (PARTITION BY r, way ORDER BY p, j) AS place FROM cut JOIN known ON known.form = trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))),
lists AS (SELECT r, way, count(*) AS n, string_agg(name, ',' ORDER BY place) AS ids, '|' || string_agg(name, '||' ORDER BY place) || '|' AS all_ids FROM found GROUP BY r, way),
held AS (SELECT DISTINCT r, k, title FROM lists JOIN rules ON all_ids LIKE chain),
above(k, over) AS (VALUES {", ".join(f"({i}, {j})" for i, own in enumerate(STRONGER) for j in own)}),
said AS (SELECT r, string_agg(DISTINCT title, ',' ORDER BY title) AS licenses FROM held h ANTI JOIN (SELECT o.r, a.k FROM above a JOIN held o ON o.k = a.over) USING (r, k) GROUP BY r)
SELECT doc_id, coalesce(CASE WHEN coalesce(y.n, 0) > coalesce(x.n, 0) THEN y.ids ELSE x.ids END, '') AS sentence_ids,
       CAST(greatest(coalesce(x.n, 0), coalesce(y.n, 0)) AS BIGINT) AS n_sentences, coalesce(licenses, '') AS licenses
FROM base LEFT JOIN lists x ON x.r = base.r AND x.way = 'lines' LEFT JOIN lists y ON y.r = base.r AND y.way = 'paragraphs' LEFT JOIN said ON said.r = base.r"""
