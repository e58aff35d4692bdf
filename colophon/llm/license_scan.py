"""License scans by sentence rules.

A text is cut into passages (at stops and at lines without letters or digits) and normalised: lower case, runs of
other characters than letters and digits become one space.  A passage that is a known licence sentence is taken
whole, however its lines are wrapped or marked as comments; any other is taken line by line.  Sentences that differ
in a holder's name, a year or the way to say the same are led to one form by GAPS before they are looked up.  The
identifiers, in text order, form a sequence in which a sentence that speaks of licences but is not known stands as
``?``.  Ordered rules, each a sequence of identifiers, are then matched and replaced by their licence, so that what a
longer rule has taken is not there for a shorter one.

Everything is a column expression: no Python runs on the executors, and nothing is shuffled or joined.

Defined results: null and empty texts have no sentence and no licence; a licence counts once a document however
often it is stated; "all rights reserved" is a result only where no licence is stated; a copyright line is known and
says nothing about the licence; a line that is only an address says nothing; known sentences that no rule takes leave
``sequence`` telling them, and no licence.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: licences by SPDX identifier, and the names that "licensed under ..." and titles give them (normalised).
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0", "apache software license version 2 0", "apache software license 2 0", "asl 2 0"],
    "MIT": ["mit license", "mit", "mit licence", "x11 license", "expat license"],
    "MIT-0": ["mit no attribution license", "mit 0 license", "mit no attribution"],
    "ISC": ["isc license", "isc", "isc licence"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause", "bsd 2 clause simplified license", "freebsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause", "bsd 3 clause new or revised license", "revised bsd license"],
    "0BSD": ["zero clause bsd license", "bsd zero clause license", "0bsd license", "0bsd"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2", "gnu general public license version 2 0", "gnu general public license v2 0"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license version 2 or any later version", "gnu general public license v2 or later", "gpl version 2 or later", "gpl v2 or later", "gplv2 or later"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3", "gnu general public license version 3 0", "gnu general public license v3 0"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license version 3 or any later version", "gnu general public license v3 or later", "gpl version 3 or later", "gpl v3 or later", "gplv3 or later"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "gnu lgpl v2 1", "lgpl version 2 1", "lgpl v2 1", "lgpl 2 1", "lgplv2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later", "gnu lesser general public license v2 1 or later", "lgpl version 2 1 or later", "lgpl v2 1 or later", "lgpl 2 1 or later", "lgplv2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "gnu lgpl v3", "lgpl version 3", "lgpl v3", "lgpl 3 0", "lgplv3"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later", "gnu lesser general public license v3 or later", "lgpl version 3 or later", "lgpl v3 or later", "lgplv3 or later"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "gnu agpl v3", "agpl version 3", "agpl v3", "agpl 3 0", "agplv3"],
    "AGPL-3.0-or-later": ["gnu affero general public license version 3 or later", "gnu affero general public license v3 or later", "agpl version 3 or later", "agpl v3 or later", "agplv3 or later"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl version 2 0", "mpl v2 0"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v1 0", "eclipse public license 1 0", "epl 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license v2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"],
    "Unlicense": ["unlicense", "the unlicense"],
    "Zlib": ["zlib license", "zlib"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "boost software license"],
    "CC0-1.0": ["cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal license", "creative commons cc0 1 0 universal public domain dedication", "creative commons zero 1 0"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported license", "creative commons attribution 3 0 license"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international", "creative commons attribution 4 0 license", "creative commons attribution 4 0"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution sharealike 3 0 license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0 license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "WTFPL": ["do what the fuck you want to public license", "wtfpl", "do what the fuck you want to public license version 2"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0", "the artistic license 2 0"],
    "PSF-2.0": ["python software foundation license", "psf license", "python software foundation license version 2"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1", "open font license version 1 1", "ofl 1 1"],
    "Apache-1.1": ["apache software license version 1 1", "apache license 1 1", "apache license version 1 1"],
    "EUPL-1.2": ["european union public licence v 1 2", "european union public licence version 1 2", "eupl v1 2", "eupl 1 2"],
}

#: Fixed: known licence sentences (normalised, after GAPS) and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0 the license": "APACHE-REF",
    "you may not use this file except in compliance with the license": "APACHE-COMPLY",
    "you may obtain a copy of the license at": "APACHE-COPY",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "APACHE-COPY",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "APACHE-COPY",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "APACHE-ASIS",
    "see the license for the specific language governing permissions and limitations under the license": "APACHE-SEE",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT-GRANT",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "MIT0-GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "MIT-NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT-ASIS",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MIT-LIABLE",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC-GRANT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0BSD-GRANT",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISC-ASIS",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISC-LIABLE",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD-GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD-SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD-BINARY",
    "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD-ENDORSE",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BSD-ADVERT",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSD-ASIS",
    "in no event shall the copyright holders or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BSD-LIABLE",
    "this program is free software": "FSF-FREE",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPL-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LGPL-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "AGPL-TERMS",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "GPL-TERMS><VERSION-2",
    "either version 2 of the license or at your option any later version": "VERSION-2+",
    "either version 2 1 of the license or at your option any later version": "VERSION-2.1+",
    "either version 3 of the license or at your option any later version": "VERSION-3+",
    "version 2 of the license": "VERSION-2",
    "version 2 1 of the license": "VERSION-2.1",
    "version 3 of the license": "VERSION-3",
    "this program is distributed in the hope that it will be useful but without any warranty": "FSF-HOPE",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "FSF-EVEN",
    "see the gnu general public license for more details": "FSF-DETAILS",
    "see the gnu lesser general public license for more details": "FSF-DETAILS",
    "see the gnu affero general public license for more details": "FSF-DETAILS",
    "you should have received a copy of the gnu general public license along with this program": "FSF-COPY",
    "you should have received a copy of the gnu lesser general public license along with this program": "FSF-COPY",
    "you should have received a copy of the gnu affero general public license along with this program": "FSF-COPY",
    "if not see": "FSF-SEE",
    "this source code form is subject to the terms of the mozilla public license v": "MPL-REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2-REF",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "EPL1-REF",
    "this is free and unencumbered software released into the public domain": "UNLICENSE-FREE",
    "this software is provided as is without any express or implied warranty": "ZLIB-ASIS",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZLIB-LIABLE",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZLIB-GRANT",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BSL-GRANT",
    "to the extent possible under law the holder has waived all copyright and related or neighboring rights to this work": "CC0-WAIVED",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed": "WTFPL-COPY",
    "copyright holder": "HOLDER",
    "all rights reserved": "RESERVED",
}
#: Fixed: what the terms of the free software licences may say in one sentence or in two.
_TERMS = {k: v for k, v in SENTENCES.items() if v in ("GPL-TERMS", "LGPL-TERMS", "AGPL-TERMS")}
SENTENCES |= {f"{terms} {version}": f"{a}><{b}" for terms, a in _TERMS.items() for version, b in SENTENCES.items() if b.startswith("VERSION-")}
SENTENCES |= {f"licensed under the {name}": f"REF-{licence}" for licence, names in NAMES.items() for name in names}
SENTENCES |= {name: f"TITLE-{licence}" for licence, names in NAMES.items() for name in names if "licen" in name}
SENTENCES |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', licence.lower()).strip()}": f"SPDX-{licence}" for licence in NAMES}
SENTENCES |= {f"spdx license identifier {old}": f"SPDX-{new}" for old, new in {"gpl 2 0": "GPL-2.0-only", "gpl 3 0": "GPL-3.0-only", "lgpl 2 1": "LGPL-2.1-only", "lgpl 3 0": "LGPL-3.0-only", "agpl 3 0": "AGPL-3.0-only"}.items()}
SENTENCES |= {f"spdx license identifier {a} or {b}": "SPDX-MIT><SPDX-Apache-2.0" for a, b in (("mit", "apache 2 0"), ("apache 2 0", "mit"))}

#: Fixed: forms of a normalised sentence that are one, in order: pattern and what it becomes.  Java and RE2 read them alike.
GAPS = [
    ("^(?:[0-9]+|[a-z]) (redistributions|neither|all advertising|the origin|altered|this notice) ", "$1 "),
    ("^neither the names? of .* nor the names of (?:its|their|any) contributors may be used", "neither the name of the holder nor the names of its contributors may be used"),
    ("^this software is provided by .* as is and any express or implied", "this software is provided by the copyright holders and contributors as is and any express or implied"),
    ("^in no event shall .* be liable for any direct indirect incidental", "in no event shall the copyright holders or contributors be liable for any direct indirect incidental"),
    ("^in no event shall .* be liable for any claim damages or other", "in no event shall the authors or copyright holders be liable for any claim damages or other"),
    ("^permission to use copy modify and distribute this", "permission to use copy modify and or distribute this"),
    ("^to the extent possible under law .* (?:has|have) waived all copyright and related", "to the extent possible under law the holder has waived all copyright and related"),
    ("^this (?:library|file|software|package|module|script|work|plugin) is (free software|distributed in the hope)", "this program is $1"),
    ("^(?:[a-z0-9]+ ){1,3}is (free software$|distributed in the hope that)", "this program is $1"),
    ("^(it is|it and or) distributed in the hope", "this program is distributed in the hope"),
    ("^(?:you can )?(redistribute it and or modify it under the terms of the gnu )(?:library|lesser) general", "you can $1lesser general"),
    ("^see the gnu library general", "see the gnu lesser general"),
    ("^(you should have received a copy of the gnu (?:lesser |affero |library )?general public license) (?:along|in the file).*$", "$1 along with this program"),
    ("^if not (?:see|write to).*$", "if not see"),
    ("^(?:.* )?(?:is|are|be|code|work|software|text|content|and|or|licence|license) (?:dual |re )?(?:licensed|released|distributed|available|provided|published|covered|made available|shared) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?", "licensed under the "),
    ("^(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?", "licensed under the "),
    ("^licen[sc]e (?:the |gnu )?(.*)$", "licensed under the $1"),
    ("^licensed under the (.*?) (?:see|a copy|which|refer|the full|for details|unless|in the) .*$", "licensed under the $1"),
    ("^licensed under the (.*) licence$", "licensed under the $1 license"),
    ("^licensed under the (.*general public license) (?:as published by the free software foundation )?(?:version|v) ?(2|3|2 1)(?: 0)?(?: of the license)? (?:or at your option any later version|or any later version|or newer)$", "licensed under the $1 version $2 or later"),
    ("^licensed under the general public", "licensed under the gnu general public"),
]

#: Fixed: a line that names who holds the copyright; only ever a line, as what follows may be a licence.
HOLDER = ("^(?:portions )?(?:c )?copyright (?:c )?(?:[0-9]{4}|by |the |c ).*$", "copyright holder")
#: Fixed: "License: name" is one sentence, though a stop follows the word.
LABEL = (r"(licen[sc]e|spdx-license-identifier):[ \t]+", "$1 ")

#: Fixed: what stands before and behind the terms of a free software licence.
_WHOLE = (("FSF-FREE",), ("FSF-HOPE", "FSF-EVEN", "FSF-DETAILS", "FSF-COPY", "FSF-SEE"))
#: Fixed: ordered rules, the identifiers in a row and the licence they state; earlier rules take first.
RULES = [
    (("APACHE-REF", "APACHE-COMPLY", "APACHE-COPY", "APACHE-ASIS", "APACHE-SEE"), "Apache-2.0"),
    (("APACHE-REF", "APACHE-COMPLY", "APACHE-COPY"), "Apache-2.0"),
    (("REF-Apache-2.0", "APACHE-COMPLY", "APACHE-COPY", "APACHE-ASIS", "APACHE-SEE"), "Apache-2.0"),
    (("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ADVERT", "BSD-ENDORSE", "BSD-ASIS", "BSD-LIABLE"), "BSD-4-Clause"),
    (("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-ASIS", "BSD-LIABLE"), "BSD-3-Clause"),
    (("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE", "BSD-ASIS"), "BSD-3-Clause"),
    (("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ENDORSE"), "BSD-3-Clause"),
    (("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS", "BSD-LIABLE"), "BSD-2-Clause"),
    (("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-ASIS"), "BSD-2-Clause"),
    (("MIT-GRANT", "MIT-NOTICE", "MIT-ASIS", "MIT-LIABLE"), "MIT"),
    (("MIT-GRANT", "MIT-NOTICE", "MIT-ASIS"), "MIT"),
    (("MIT-GRANT", "MIT-NOTICE"), "MIT"),
    (("MIT0-GRANT", "MIT-ASIS", "MIT-LIABLE"), "MIT-0"),
    (("ISC-GRANT", "ISC-ASIS", "ISC-LIABLE"), "ISC"),
    (("ISC-GRANT", "ISC-ASIS"), "ISC"),
    (("0BSD-GRANT", "ISC-ASIS", "ISC-LIABLE"), "0BSD"),
    (("0BSD-GRANT", "ISC-ASIS"), "0BSD"),
    *[
        ((*before, f"{kind}-TERMS", f"VERSION-{n}{mark}", *behind), f"{kind}-{n}{'' if '.' in n else '.0'}-{said}")
        for before, behind in (_WHOLE, (_WHOLE[0], _WHOLE[1][:-1]), (_WHOLE[0], ()), ((), ()))
        for mark, said in (("+", "or-later"), ("", "only"))
        for kind in ("GPL", "LGPL", "AGPL")
        for n in ("2", "2.1", "3")
    ],
    (("UNLICENSE-FREE",), "Unlicense"),
    (("ZLIB-ASIS", "ZLIB-LIABLE", "ZLIB-GRANT"), "Zlib"),
    (("BSL-GRANT",), "BSL-1.0"),
    (("CC0-WAIVED",), "CC0-1.0"),
    (("WTFPL-COPY",), "WTFPL"),
    (("APACHE-REF",), "Apache-2.0"),
    (("MPL-REF",), "MPL-2.0"),
    (("EPL2-REF",), "EPL-2.0"),
    (("EPL1-REF",), "EPL-1.0"),
    (("RESERVED",), "LicenseRef-all-rights-reserved"),
]
#: Fixed: a reference by name or identifier states its licence, after all rules.
REFERENCE = ("<(?:REF|SPDX)-([^>]+)>", "[$1]")
#: Said of a text only if no licence is stated.
RESERVED = "LicenseRef-all-rights-reserved"

#: Fixed: a sentence with one of these speaks of licences.
CLUE_WORDS = ["licen", "copyright", "permission", "permitted", "redistribut", "warrant", "liable", "free software", "all rights reserved", "gnu general", "provided as is", "advertising materials", "public domain", "waived", "released under", "distributed under", "available under", "gpl"]
CLUES = "|".join(CLUE_WORDS)
#: A line that holds nothing but an address.
ADDRESS = r"^[^a-z0-9]*https?://[^\x00-\x20]+[\x00-\x20]*$"
#: Where a passage ends: white space behind one of these, or a line without (ASCII) letters and digits.
STOP, BLANK = r"([.!?;:])[ \t\r\n]+", r"\n[^a-z0-9]*\n"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _form(plain: Column, known: Column, gaps: list[tuple[str, str]]) -> Column:
    """The sentence itself if it is known, else the form that ``gaps`` lead it to."""
    form = plain
    for pattern, to in gaps:
        form = F.regexp_replace(form, pattern, to)
    return F.when(F.map_contains_key(known, plain), plain).otherwise(form)


def sentences(lower: Column, known: Column) -> Column:
    """Normalised sentences of a lower-case text that speak of licences, in text order."""
    lower = F.regexp_replace(lower, *LABEL)
    passages = F.split(F.regexp_replace(lower, STOP, "$1\n\n"), BLANK)

    def line(x: Column) -> Column:
        return F.when(x.rlike(CLUES) & ~x.rlike(ADDRESS), _form(_plain(x), known, [HOLDER, *GAPS])).otherwise("")

    def cut(passage: Column) -> Column:
        whole = _form(_plain(passage), known, GAPS)
        return F.when(~passage.rlike(CLUES), F.array().cast("array<string>")).when(F.map_contains_key(known, whole), F.array(whole)).otherwise(F.transform(F.split(passage, "\n+"), line))

    return F.filter(F.flatten(F.transform(passages, cut)), lambda s: s != "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (sorted, joined by "; "), n_known and n_unknown sentences, sequence (what the rules made)."""
    known = F.from_json(F.lit(json.dumps(SENTENCES)), "map<string,string>")  # a constant, folded once
    marks = F.transform("found", lambda s: F.concat(F.lit("<"), F.coalesce(F.try_element_at(known, s), F.lit("?")), F.lit(">")))
    # most texts hold no clue at all: they are not cut up, and plain searches tell it far faster than a pattern
    clue = reduce(or_, [F.contains("lower", F.lit(w)) for w in CLUE_WORDS])
    found = F.when(clue, sentences(F.col("lower"), known)).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("lower"))
    rows = rows.select("doc_id", found.alias("found")).select("doc_id", F.array_join(marks, "").alias("marks"))
    sequence = F.col("marks")
    for ids, licence in RULES[:-1]:
        sequence = F.replace(sequence, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"[{licence}]"))
    sequence = F.replace(F.regexp_replace(sequence, *REFERENCE), F.lit("<RESERVED>"), F.lit(f"[{RESERVED}]"))
    count = lambda pattern: F.regexp_count("marks", F.lit(pattern)).cast("long")
    rows = rows.select("doc_id", count("<[^?>]+>").alias("n_known"), count(r"<\?>").alias("n_unknown"), F.when(F.col("marks") == "", "").otherwise(sequence).alias("sequence"))
    stated = F.array_sort(F.array_distinct(F.regexp_extract_all("sequence", F.lit(r"\[([^\]]+)\]"), 1)))
    rows = rows.withColumn("stated", stated)
    licences = F.array_join(F.filter("stated", lambda x: (x != RESERVED) | (F.size("stated") == 1)), "; ")
    return rows.select("doc_id", licences.alias("licences"), "n_known", "n_unknown", "sequence")


def _sql_form(plain: str, gaps: list[tuple[str, str]]) -> str:
    form = plain
    for pattern, to in gaps:
        form = f"regexp_replace({form}, '{pattern}', '{to.replace('$', chr(92))}')"
    return f"CASE WHEN {plain} IN (SELECT sentence FROM known) THEN {plain} ELSE {form} END"


def oracle() -> str:
    """The same in SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    sequence = "sequence"
    for ids, licence in RULES[:-1]:
        sequence = f"replace({sequence}, '{''.join(f'<{i}>' for i in ids)}', '[{licence}]')"
    sequence = rf"replace(regexp_replace({sequence}, '{REFERENCE[0]}', '[\1]', 'g'), '<RESERVED>', '[{RESERVED}]')"
    return rf"""
        WITH known(sentence, id) AS (VALUES {values}),
        s AS (SELECT doc_id, row, unnest(parts) AS raw, generate_subscripts(parts, 1) AS pos
              FROM (SELECT doc_id, row_number() OVER () AS row,
                           string_split_regex(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{LABEL[0]}', '\1 ', 'g'), '{STOP}', '\1' || repeat(chr(10), 2), 'g'), '{BLANK}') AS parts FROM documents)),
        p AS (SELECT *, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS plain FROM s WHERE regexp_matches(raw, '{CLUES}')),
        w AS (SELECT *, {_sql_form('plain', GAPS)} AS whole FROM p),
        l AS (SELECT doc_id, row, pos, whole IN (SELECT sentence FROM known) AS one, CASE WHEN whole IN (SELECT sentence FROM known) THEN [whole] ELSE string_split_regex(raw, '\n+') END AS lines FROM w),
        n AS (SELECT doc_id, row, pos, one, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM l),
        o AS (SELECT *, trim(regexp_replace(line, '[^a-z0-9]+', ' ', 'g')) AS plain FROM n WHERE one OR regexp_matches(line, '{CLUES}') AND NOT regexp_matches(line, '{ADDRESS}')),
        q AS (SELECT doc_id, row, pos, nr, CASE WHEN one THEN line ELSE {_sql_form('plain', [HOLDER, *GAPS])} END AS sentence FROM o),
        m AS (SELECT row, string_agg('<' || coalesce(id, '?') || '>', '' ORDER BY pos, nr) AS sequence FROM q LEFT JOIN known USING (sentence) WHERE q.sentence <> '' GROUP BY row),
        d AS (SELECT doc_id, coalesce(m.sequence, '') AS sequence FROM (SELECT DISTINCT doc_id, row FROM s) LEFT JOIN m USING (row)),
        r AS (SELECT doc_id, len(regexp_extract_all(sequence, '<[^?>]+>')) AS n_known, len(regexp_extract_all(sequence, '<\?>')) AS n_unknown,
                     {sequence} AS sequence FROM d),
        t AS (SELECT *, list_sort(list_distinct(regexp_extract_all(sequence, '\[([^\]]+)\]', 1))) AS stated FROM r)
        SELECT doc_id, array_to_string(list_filter(stated, lambda x: x <> '{RESERVED}' OR len(stated) = 1), '; ') AS licences,
               CAST(n_known AS BIGINT) AS n_known, CAST(n_unknown AS BIGINT) AS n_unknown, sequence FROM t"""
