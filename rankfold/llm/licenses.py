"""License scans with ordered signature rules, as expressions of one row: no shuffle, no Python.

A text becomes its words, lower-cased and separated by single blanks. A few roots decide whether any rule can apply; a
rule's own keyword gates its regular expression. Detections are word intervals with a priority. Sorted by start, a
detection is dropped if it lies within one that is at least as strong.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Control characters around a match; no word holds them.
BEGIN, END = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labels and the names that stand for them, as regular expressions over words.
NAMES = [
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl)(?: v| version | )2(?: 0)?"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl)(?: v| version | )3(?: 0)?"),
    ("gpl", r"(?:gnu general public license|gnu gpl)"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|lgpl)(?: v| version | )2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl)(?: v| version | )3(?: 0)?"),
    ("lgpl", r"(?:gnu lesser general public license|gnu lgpl)"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl)(?: v| version | )3(?: 0)?"),
    ("agpl", r"(?:gnu affero general public license|gnu agpl)"),
    ("gfdl-1.3", r"(?:gnu )?free documentation license(?: version)? 1 3"),
    ("gfdl", r"gnu free documentation license"),
    ("apache-2.0", r"apache(?: software)? license(?: v| version | )2(?: 0)?"),
    ("apache-1.1", r"apache(?: software)? license(?: v| version | )1 1"),
    ("apache", r"apache(?: software)? license"),
    ("mit", r"(?:mit|expat) license"),
    ("x11", r"x11 license"),
    ("isc", r"isc license"),
    ("bsd-2-clause", r"(?:simplified bsd license|bsd 2 clause(?: license)?|2 clause bsd license)"),
    ("bsd-3-clause", r"(?:new bsd license|modified bsd license|bsd 3 clause(?: license)?|3 clause bsd license)"),
    ("bsd", r"bsd license"),
    ("mpl-1.1", r"mozilla public license(?: v| version | )1 1"),
    ("mpl-2.0", r"mozilla public license(?: v| version | )2(?: 0)?"),
    ("epl-1.0", r"eclipse public license(?: v| version | )1(?: 0)?"),
    ("epl-2.0", r"eclipse public license(?: v| version | )2(?: 0)?"),
    ("cpl-1.0", r"common public license(?: v| version | )1(?: 0)?"),
    ("cddl-1.0", r"common development and distribution license(?: version)?(?: 1 0)?"),
    ("cc-by-nc-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial) (?:nd|noderivatives)(?: [1-4] \d)?"),
    ("cc-by-nc-sa", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial) (?:sa|sharealike)(?: [1-4] \d)?"),
    ("cc-by-nc", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial)(?: [1-4] \d)?"),
    ("cc-by-nd", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives)(?: [1-4] \d)?"),
    ("cc-by-sa", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike)(?: [1-4] \d)?"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: [1-4] \d)?"),
    ("cc0-1.0", r"(?:cc0(?: 1 0)?|creative commons zero(?: license)?)"),
    ("unlicense", r"the unlicense"),
    ("zlib", r"zlib license"),
    ("bsl-1.0", r"boost software license(?: version)?(?: 1 0)?"),
    ("artistic-2.0", r"artistic license(?: version)? 2(?: 0)?"),
    ("wtfpl", r"do what the fuck you want to public license"),
    ("ofl-1.1", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("ms-pl", r"microsoft public license"),
    ("ms-rl", r"microsoft reciprocal license"),
    ("python-2.0", r"(?:psf|python software foundation) license(?: version)?(?: 2)?"),
    ("php-3.01", r"php license(?: version)?(?: 3 01)?"),
    ("postgresql", r"postgresql license"),
    ("openssl", r"openssl license"),
    ("eupl-1.2", r"european union public licen[cs]e(?: version)?(?: 1 2)?"),
    ("ecl-2.0", r"educational community license(?: version)?(?: 2 0)?"),
    ("ncsa", r"university of illinois ncsa open source license"),
    ("afl-3.0", r"academic free license(?: version)?(?: 3 0)?"),
    ("osl-3.0", r"open software license(?: version)?(?: 3 0)?"),
    ("odbl-1.0", r"open database license(?: version)?(?: 1 0)?"),
    ("qpl-1.0", r"q public license(?: version)?(?: 1 0)?"),
    ("sleepycat", r"sleepycat license"),
]

#: What may stand around a name: strength (1 is strongest), and an expression with {} for the name.
FORMS = [
    (1, r"(?:licensed|distributed|released|available|provided|published) under (?:the terms of )?(?:the |a )?{}"),
    (1, r"(?:is|are) subject to the (?:terms of the )?{}"),
    (2, r"license(?:d)?(?: is| as)? (?:the )?{}"),
    (3, r"(?:see|read|under) the {}"),
    (3, r"{}"),
]

#: Keywords of names that begin with alternatives: a text must hold one of them. Other names hold their first words.
KEYWORDS = {
    "gpl": ("general public license", "gpl"),
    "lgpl": ("lesser general public", "lgpl"),
    "agpl": ("affero general public", "agpl"),
    "gfdl": ("free documentation license", "free documentation license"),
    "mit": ("mit license", "expat license"),
    "cc": ("creative commons", "cc by", "cc attribution"),
    "cc0": ("creative commons", "cc0"),
    "bsd": ("bsd", "bsd"),
    "ofl": ("open font license", "open font license"),
    "python": ("psf license", "python software foundation"),
}

#: Rules in words of their own, from notices and conditions of the licenses: label, strength, expression, keyword.
OTHERS = [
    ("public-domain", 1, r"(?:dedicated|released|placed) (?:to|into|in) the public domain", "public domain"),
    ("public-domain", 3, r"public domain", "public domain"),
    ("public-domain", 1, r"(?:this|the) (?:file|work|code|program|software) is (?:hereby )?(?:in )?(?:the )?public domain", "public domain"),
    ("public-domain", 2, r"(?:no|disclaims?|without) copyright(?: is claimed| protection)?(?: [^ ]+){0,6} public domain", "public domain"),
    ("unlicense", 1, r"this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("unlicense", 1, r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("unlicense", 2, r"for more information please refer to (?:http |https )?unlicense org", "unlicense org"),
    ("cc0-1.0", 1, r"to the extent possible under law(?: [^ ]+){1,12} (?:waived|waive) all copyright and related or neighboring rights", "related or neighboring rights"),
    ("cc0-1.0", 2, r"creativecommons org publicdomain zero 1 0", "publicdomain zero"),
    ("all-rights-reserved", 2, r"all rights reserved", "rights reserved"),
    ("all-rights-reserved", 1, r"no part of this (?:publication|book|work|document) may be (?:reproduced|copied|distributed)", "no part of this"),
    ("proprietary", 1, r"(?:proprietary and confidential|confidential and proprietary)(?: information)?", "proprietary"),
    ("proprietary", 1, r"unauthorized (?:copying|reproduction|distribution|use) of this (?:file|software|program|work)", "unauthorized"),
    ("proprietary", 2, r"may not be (?:copied|reproduced|disclosed|distributed)(?: [^ ]+){0,8} without(?: the)?(?: prior)?(?: express)? written permission", "written permission"),
    ("mit", 1, r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("mit", 1, r"of this software and associated documentation files the software to deal in the software without restriction", "deal in the software"),
    ("mit", 2, r"the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "rights to use copy modify merge"),
    ("mit", 1, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice"),
    ("mit", 2, r"opensource org licenses mit(?: license)?(?: php| html)?", "opensource org licenses mit"),
    ("mit-0", 1, r"mit no attribution(?: license)?", "mit no attribution"),
    ("mit-advertising", 1, r"except as contained in this notice the names? of(?: [^ ]+){1,12} shall not be used in advertising", "except as contained in this notice"),
    ("bsd", 1, r"redistribution and use in source and binary forms with or without modification", "redistribution and use"),
    ("bsd-2-clause", 2, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code"),
    ("bsd-2-clause", 2, r"redistributions in binary form must reproduce the above copyright notice this list of conditions", "redistributions in binary form"),
    ("bsd-3-clause", 1, r"neither the names? of(?: [^ ]+){1,16} may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("bsd-4-clause", 1, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials"),
    ("bsd", 2, r"opensource org licenses bsd(?: license)?(?: php| html)?", "opensource org licenses bsd"),
    ("bsd", 3, r"(?:use of this source code is governed by|governed by) a bsd style license", "bsd style license"),
    ("bsd-0-clause", 1, r"(?:0bsd|zero clause bsd)(?: license)?", "bsd"),
    ("isc", 1, r"permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("isc", 1, r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "permission to use"),
    ("hpnd", 1, r"permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use"),
    ("hpnd", 2, r"that (?:both )?(?:that|the) copyright notice and this permission notice appear in supporting documentation", "permission notice appear"),
    ("zlib", 1, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable"),
    ("zlib", 1, r"altered source versions must be plainly marked as such and must not be misrepresented", "altered source versions"),
    ("zlib", 2, r"the origin of this software must not be misrepresented", "origin of this software"),
    ("apache-2.0", 1, r"licensed under the apache license version 2 0 the license", "apache license"),
    ("apache-2.0", 1, r"(?:http |https )?(?:www )?apache org licenses license 2 0(?: txt| html)?", "apache org licenses"),
    ("apache-2.0", 2, r"you may not use this file except in compliance with the license", "in compliance with the license"),
    ("apache-2.0", 2, r"unless required by applicable law or agreed to in writing software distributed under the license", "agreed to in writing"),
    ("apache-1.1", 1, r"this product includes software developed by the apache software foundation", "apache software foundation"),
    ("asf-contributor", 1, r"licensed to the apache software foundation(?: asf)? under one or more contributor license agreements", "contributor license agreements"),
    ("gpl", 1, r"(?:you can|you may) redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify"),
    ("gpl-2.0-or-later", 1, r"either version 2(?: of the license)? or at your option any later version", "either version 2"),
    ("gpl-3.0-or-later", 1, r"either version 3(?: of the license)? or at your option any later version", "either version 3"),
    ("gpl", 2, r"you should have received a copy of the gnu general public license(?: along with this [^ ]+)?", "should have received a copy"),
    ("gpl", 2, r"see the gnu general public license for more details", "general public license"),
    ("gpl", 2, r"(?:www )?gnu org (?:licenses|copyleft) gpl(?: html| txt)?", "gnu org"),
    ("gpl-2.0", 2, r"gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?", "gnu org"),
    ("gpl-3.0", 2, r"gnu org licenses gpl 3 0(?: html| txt)?", "gnu org"),
    ("lgpl", 1, r"(?:you can|you may) redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "redistribute it and or modify"),
    ("lgpl", 2, r"you should have received a copy of the gnu (?:lesser|library) general public license", "should have received a copy"),
    ("lgpl-2.0", 1, r"gnu library general public license(?: version 2(?: 0)?)?", "gnu library general public"),
    ("lgpl-2.1-or-later", 1, r"either version 2 1(?: of the license)? or at your option any later version", "either version 2"),
    ("lgpl", 2, r"gnu org licenses lgpl(?: \d)*(?: html| txt)?", "gnu org"),
    ("agpl", 1, r"(?:you can|you may) redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute it and or modify"),
    ("agpl", 2, r"you should have received a copy of the gnu affero general public license", "should have received a copy"),
    ("agpl-3.0", 2, r"gnu org licenses agpl(?: 3 0)?(?: html| txt)?", "gnu org"),
    ("gfdl", 1, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "copy distribute and or modify this document"),
    ("gfdl", 2, r"with no invariant sections(?: with)? no front cover texts(?: and)?(?: with)? no back cover texts", "no invariant sections"),
    ("gpl-classpath-exception", 1, r"as a special exception(?: [^ ]+){1,20} permission to link this library with independent modules", "independent modules"),
    ("gpl-gcc-exception", 1, r"gcc runtime library exception(?: version 3 1)?", "gcc runtime library exception"),
    ("gpl-autoconf-exception", 1, r"as a special exception to the gnu general public license if you distribute this file as part of a program", "as a special exception"),
    ("mpl-2.0", 1, r"this source code form is subject to the terms of the mozilla public license", "source code form"),
    ("mpl-2.0", 1, r"if a copy of the mpl was not distributed with this file", "copy of the mpl"),
    ("mpl-2.0", 2, r"mozilla org mpl 2 0", "mozilla org"),
    ("mpl-1.1", 1, r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file"),
    ("npl", 1, r"the contents of this file are subject to the netscape public license", "contents of this file"),
    ("epl-1.0", 1, r"eclipse org legal epl v10(?: html)?", "eclipse org legal"),
    ("epl-2.0", 1, r"eclipse org legal epl (?:v20|2 0)(?: html)?", "eclipse org legal"),
    ("epl", 2, r"this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials"),
    ("edl-1.0", 1, r"eclipse distribution license(?: v| version)?(?: 1 0)?", "eclipse distribution license"),
    ("cddl", 1, r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file"),
    ("cpl-1.0", 2, r"accompanying materials are made available under the terms of the common public license", "accompanying materials"),
    ("ms-pl", 2, r"subject to the microsoft public license", "microsoft public license"),
    ("ms-eula", 1, r"microsoft software license terms", "microsoft software license"),
    ("boost", 1, r"permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("bsl-1.0", 1, r"(?:see accompanying file license 1 0 txt or copy at )?(?:www )?boost org license 1 0 txt", "boost org"),
    ("artistic", 2, r"under the same terms as perl(?: itself)?", "same terms as perl"),
    ("artistic-1.0", 2, r"(?:perl|clarified) artistic license", "artistic license"),
    ("openssl", 1, r"this product includes software developed by the openssl project", "openssl project"),
    ("ssleay", 1, r"this product includes cryptographic software written by eric young", "cryptographic software written"),
    ("openldap", 1, r"openldap public license(?: version 2 8)?", "openldap public license"),
    ("w3c", 1, r"w3c software (?:and document )?(?:notice and )?license", "w3c software"),
    ("unicode", 1, r"unicode(?: inc)? license agreement(?: data files and software)?", "unicode"),
    ("icu", 1, r"icu license(?: icu 1 8 1 and later)?", "icu license"),
    ("curl", 1, r"curl license", "curl license"),
    ("libpng", 1, r"(?:png reference library license|libpng license)(?: version 2)?", "license"),
    ("ijg", 1, r"this software is based in part on the work of the independent jpeg group", "independent jpeg group"),
    ("freetype", 1, r"(?:the )?freetype project license|portions of this software are copyright(?: [^ ]+){0,6} the freetype project", "freetype project"),
    ("vim", 1, r"vim license", "vim license"),
    ("ruby", 1, r"same terms as ruby(?: itself)?", "terms as ruby"),
    ("lppl-1.3", 1, r"latex project public license(?: v| version)?(?: 1 3[abc]?)?", "latex project public license"),
    ("lppl", 2, r"this work has the lppl maintenance status", "lppl maintenance"),
    ("ofl-1.1", 1, r"this font software is licensed under the sil open font license", "font software"),
    ("ofl-1.1", 2, r"scripts sil org ofl", "sil org ofl"),
    ("bitstream-vera", 1, r"bitstream vera is a trademark of bitstream", "bitstream vera"),
    ("ubuntu-font-1.0", 1, r"ubuntu font licen[cs]e(?: version)?(?: 1 0)?", "ubuntu font"),
    ("beerware", 1, r"the beer ware license(?: revision 42)?", "beer ware"),
    ("beerware", 1, r"if we meet some day and you think this stuff is worth it you can buy me a beer", "buy me a beer"),
    ("wtfpl", 1, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", "verbatim or modified copies"),
    ("json", 1, r"the software shall be used for good not evil", "good not evil"),
    ("sspl-1.0", 1, r"server side public license(?: v| version)?(?: 1)?", "server side public license"),
    ("busl-1.1", 1, r"business source license(?: v| version)?(?: 1 1)?", "business source license"),
    ("elastic-2.0", 1, r"elastic license(?: v| version)?(?: 2(?: 0)?)?", "elastic license"),
    ("commons-clause", 1, r"commons clause license condition(?: v1 0)?", "commons clause"),
    ("polyform", 1, r"polyform (?:noncommercial|shield|strict|small business|perimeter) license(?: 1 0 0)?", "polyform"),
    ("mulan-psl-2.0", 1, r"mulan permissive software license(?: v2| version 2)?", "mulan permissive"),
    ("blueoak-1.0", 1, r"blue oak model license(?: 1 0 0)?", "blue oak model"),
    ("upl-1.0", 1, r"universal permissive license(?: v| version)?(?: 1 0)?", "universal permissive license"),
    ("eupl", 2, r"licensed under the eupl(?: v| version)?(?: 1 [12])?", "eupl"),
    ("cecill", 1, r"cecill (?:b |c )?(?:free software )?license(?: agreement)?", "cecill"),
    ("rpl-1.5", 1, r"reciprocal public license(?: version)?(?: 1 5)?", "reciprocal public license"),
    ("cpal-1.0", 1, r"common public attribution license(?: version)?(?: 1 0)?", "common public attribution"),
    ("ipl-1.0", 1, r"ibm public license(?: version)?(?: 1 0)?", "ibm public license"),
    ("apsl-2.0", 1, r"apple public source license(?: version)?(?: 2(?: 0)?)?", "apple public source"),
    ("nasa-1.3", 1, r"nasa open source agreement(?: version)?(?: 1 3)?", "nasa open source"),
    ("zpl-2.1", 1, r"zope public license(?: zpl)?(?: version)?(?: 2 [01])?", "zope public license"),
    ("sissl", 1, r"sun industry standards source license", "sun industry standards"),
    ("bcl-java", 1, r"binary code license agreement", "binary code license"),
    ("intel-simplified", 1, r"intel simplified software license", "intel simplified"),
    ("nvidia-eula", 1, r"nvidia software license agreement", "nvidia software license"),
    ("openrail", 1, r"(?:creativeml )?open rail (?:m|s|d|ms)(?: license)?", "open rail"),
    ("llama-community", 1, r"llama(?: \d)* community license(?: agreement)?", "community license"),
    ("cc-by-4.0", 1, r"creativecommons org licenses by 4 0", "creativecommons org licenses"),
    ("cc-by-3.0", 1, r"creativecommons org licenses by 3 0", "creativecommons org licenses"),
    ("cc-by-sa", 1, r"creativecommons org licenses by sa(?: [1-4] \d)?", "creativecommons org licenses"),
    ("cc-by-nc", 1, r"creativecommons org licenses by nc(?: [1-4] \d)?", "creativecommons org licenses"),
    ("cc-by-nd", 1, r"creativecommons org licenses by nd(?: [1-4] \d)?", "creativecommons org licenses"),
    ("cc-by-nc-sa", 1, r"creativecommons org licenses by nc sa(?: [1-4] \d)?", "creativecommons org licenses"),
    ("cc-by-nc-nd", 1, r"creativecommons org licenses by nc nd(?: [1-4] \d)?", "creativecommons org licenses"),
    ("cc", 3, r"some rights reserved", "rights reserved"),
    ("odc-by-1.0", 1, r"open data commons attribution license(?: v| version)?(?: 1 0)?", "open data commons"),
    ("odc-pddl-1.0", 1, r"(?:open data commons )?public domain dedication (?:and )?license", "public domain dedication"),
    ("cdla-permissive", 1, r"community data license agreement permissive(?: version)?(?: [12] 0)?", "community data license"),
    ("cdla-sharing", 1, r"community data license agreement sharing(?: version)?(?: 1 0)?", "community data license"),
    ("ogl-uk-3.0", 1, r"open government licen[cs]e(?: v[123]| version [123])?(?: 0)?", "open government licen"),
    ("contributor-agreement", 3, r"contributor license agreement", "contributor license agreement"),
    ("warranty-disclaimer", 3, r"without warranty of any kind(?: either)?(?: express(?:ed)? or implied)?", "without warranty of any kind"),
    ("warranty-disclaimer", 3, r"without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty"),
    ("copyleft", 3, r"(?:strong|weak) copyleft(?: license)?", "copyleft"),
    ("permissive", 3, r"permissive(?: free| open source)? (?:software )?licen[cs]e", "permissive"),
    ("freeware", 3, r"this (?:software|program) is freeware(?: and may be [^ ]+ freely)?", "freeware"),
    ("shareware", 3, r"this (?:software|program) is shareware", "shareware"),
    ("non-commercial", 2, r"for (?:non commercial|noncommercial|personal|academic|research)(?: and (?:educational|research))? use only", "use only"),
    ("evaluation", 2, r"for (?:evaluation|trial|internal) use only", "use only"),
    ("see-license-file", 3, r"see (?:the )?(?:accompanying )?licen[cs]e (?:file|txt)(?: for (?:details|more information))?", "licen"),
    ("spdx", 2, r"spdx license identifier [a-z0-9]+(?: \d)*", "spdx"),
]

#: Most expressions contain one of these.
ROOTS = ["licen", "general public", "gpl", "cc by", "cc0", "creative commons", "bsd", "public domain", "rights reserved", "redistribut", "permission", "copyright", "spdx"]

#: Base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

STRENGTHS = 3
_CONFIDENCE = [1.0, 0.8, 0.6]


def rules() -> list[tuple[str, int, str, tuple[str, ...]]]:
    """(label, strength, expression, keywords) of all rules: every form with every name, and the others."""
    made = []
    for label, name in NAMES:
        literal = re.match("[a-z0-9 ]*", name)[0].strip()
        words = KEYWORDS.get(label.split("-")[0], (literal, literal))
        made += [(label, strength, form.format(name), words) for strength, form in FORMS]
    return made + [(label, strength, expression, (word, word)) for label, strength, expression, word in OTHERS]


def roots() -> list[str]:
    """A text without any of these matches no rule: ROOTS, and the keywords of the rules that may do without."""
    return ROOTS + [w for w in dict.fromkeys(word for *_, gate in rules() for word in gate) if not any(r in w for r in ROOTS)]


def _any_of(phrases: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains("words", F.lit(p)) for p in dict.fromkeys(phrases)])


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _marked(words: Column, expression: str) -> Column:
    """The text before the first match of an expression that begins and ends at word borders, then each match with what follows it.

    The expression is a literal, so Spark compiles it once, and the text is scanned once.
    """
    return F.split(F.regexp_replace(words, F.lit(expression), F.lit(f"{BEGIN}$0{END}")), BEGIN, -1)


def _places(pieces: Column) -> Column:
    """[start, end) word intervals of the matches of _marked()."""
    before = F.struct((_blanks(pieces[0]) - 1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + _blanks(F.substring_index(piece, END, 1)) + 1
        here = F.struct(state["at"].cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct((state["at"] + _blanks(piece)).alias("at"), F.concat(state["found"], F.array(here)).alias("found"))

    return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), before, step, lambda state: state["found"])


def _swept(detections: Column) -> Column:
    """Detections that no other one, at least as strong, contains. Input [start, back = -end, strength, label]."""
    kind = "array<struct<start:int,back:int,strength:int,label:string>>"
    begin = F.struct(F.array(*[F.lit(-1)] * STRENGTHS).alias("reach"), F.array().cast(kind).alias("found"))

    def step(state: Column, d: Column) -> Column:
        end = -d["back"]
        hidden = F.exists(F.slice(state["reach"], F.lit(1), d["strength"]), lambda r: r >= end)
        reach = F.transform(state["reach"], lambda r, i: F.when(i + 1 == d["strength"], F.greatest(r, end)).otherwise(r))
        return F.struct(reach.alias("reach"), F.when(hidden, state["found"]).otherwise(F.concat(state["found"], F.array(d))).alias("found"))

    return F.aggregate(F.array_sort(detections), begin, step, lambda state: state["found"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """[id_col, n_words, places, detections], one row per row of docs.

    places are the [start, end, label] word intervals of the base phrases, all of them; detections are the
    [start, end, strength, label] intervals of the signature rules after suppression.

    * A null or word-free text has no words, places or detections. Null or repeated ids and repeated rows are passed through.
    * Ties: of equal intervals the stronger one stays, then the one whose label sorts first.
    * An empty table gives an empty table. Other columns are ignored. A very long text is scanned whole, as one cell.
    """
    plain = F.translate(F.coalesce(docs[text_col], F.lit("")), _UPPER, _LOWER)
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, BETWEEN, " ")), F.lit(" "))
    rows = docs.select(docs[id_col].alias("id"), words.alias("words"))

    by_words: dict[tuple[str, ...], list[Column]] = {}
    for label, strength, expression, gate in rules():
        pieces = _marked(F.col("words"), f"(?<= )(?:{expression})(?= )")
        by_words.setdefault(gate, []).append(F.struct(pieces.alias("pieces"), F.lit(strength).alias("s"), F.lit(label).alias("n")))
    gated = [F.when(_any_of(gate), F.array(*made)) for gate, made in by_words.items()]
    matched = F.filter(F.flatten(F.filter(F.array(*gated), lambda r: r.isNotNull())), lambda r: F.size(r["pieces"]) > 1)
    signed = F.flatten(
        F.transform(
            matched,
            lambda r: F.transform(_places(r["pieces"]), lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), r["s"].alias("strength"), r["n"].alias("label"))),
        )
    )
    listed = F.array(*[F.struct(_marked(F.col("words"), _all_places(p)).alias("pieces"), F.lit(len(p.split())).alias("w"), F.lit(n).alias("n")) for p, n in phrases])
    base = F.flatten(
        F.transform(listed, lambda r: F.transform(_places(r["pieces"]), lambda p: F.struct(p["start"].alias("start"), (p["start"] + r["w"]).alias("end"), r["n"].alias("label"))))
    )
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    found = rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("words") == "  ", F.lit(0)).otherwise(_blanks(F.col("words")) - 1).cast("bigint").alias("n_words"),
        F.when(_any_of([f" {p} " for p, _ in phrases]), base).otherwise(none("start:int,end:int,label:string")).alias("places"),
        F.when(_any_of(roots()), _swept(signed)).otherwise(none("start:int,back:int,strength:int,label:string")).alias("kept"),
    )
    shown = F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["strength"].alias("strength"), d["label"].alias("label")))
    return found.select(id_col, "n_words", "places", shown.alias("detections"))


def _all_places(phrase: str) -> str:
    """Matches the first word of every place of a phrase, also of places that overlap."""
    first, _, rest = phrase.partition(" ")
    return f"(?<= ){first}(?= {rest} )" if rest else f"(?<= ){first}(?= )"


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """[id_col, n_words, n_base, first_word, last_word, base_labels, labels, score] of scanned() rows."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts, base = F.col("places.start"), F.col("places.label")
    strongest = F.array_min(F.col("detections.strength"))
    return found.select(
        id_col,
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.col("detections.label"))).alias("labels"),
        F.when(strongest.isNotNull(), F.element_at(F.array(*map(F.lit, _CONFIDENCE)), strongest)).otherwise(F.lit(0.0)).alias("score"),
    )
