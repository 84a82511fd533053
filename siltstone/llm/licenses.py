"""License scans by ordered signature rules.

Rules are hand-written regular expressions over the ASCII-lower-cased text. Each names the
keywords without which it cannot match; one Aho-Corasick pass over a text finds which keywords
occur, and only the rules that they gate are run. Detections are resolved in the order of
priority: a detection whose span lies inside the span of one with a higher priority, or of an
equal priority and an earlier rule, is suppressed. Detections that merely overlap all stay.

The base of the contract (three phrases, matched word by word) is found on its own and its labels
are never suppressed.

Definitions: null texts are empty; they have no words, no label and score 0. ``score`` is
1 - product(1 - confidence) over the labels that stay, 0 without any. Rows are independent: ties
and repeated rows get the same result each. Texts are scanned whole, whatever their length.

Scale: one narrow pass, no shuffle; memory is one slice of a batch.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import words as W
from siltstone.llm.arrow import map_slices
from siltstone.runtime import table

#: Fixed values of the contract: phrase, label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

S = r"[\s\-_.,;:()\"'/*#]+"  # between words

#: Rules: (label, priority, confidence, keywords, expression). In an expression a blank stands for S.
#: Higher priorities are more specific texts: 9 full grants, 7 named versions, 5 names, 3 hints.
RULES: list[tuple[str, int, float, tuple[str, ...], str]] = [
    # MIT and its kin
    ("mit", 9, 0.99, ("permission is hereby granted",), r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 7, 0.95, ("mit license",), r"\b(?:under|released under|licensed under) the mit license\b"),
    ("mit", 5, 0.9, ("mit license", "mit licence"), r"\b(?:the )?mit licen[sc]e\b"),
    ("mit", 5, 0.8, ("mit-licensed", "mit licensed"), r"\bmit licensed\b"),
    ("mit", 5, 0.8, ("expat",), r"\bexpat licen[sc]e\b"),
    ("mit-0", 7, 0.95, ("mit no attribution", "mit-0"), r"\bmit (?:no attribution|0)\b"),
    ("x11", 5, 0.9, ("x11",), r"\bx11 licen[sc]e\b"),
    ("isc", 9, 0.97, ("permission to use",), r"permission to use copy modify and(?: or|/or) distribute this software for any purpose with or without fee"),
    ("isc", 5, 0.9, ("isc licen",), r"\bisc licen[sc]e\b"),
    ("0bsd", 7, 0.95, ("0bsd", "zero clause"), r"\b(?:0bsd|(?:bsd )?zero clause(?: bsd)?)\b"),
    # BSD
    ("bsd-3-clause", 9, 0.97, ("endorse or promote",), r"neither the names? of [^.\n]{1,120} nor the names of (?:its|the|any) contributors may be used to endorse or promote"),
    ("bsd-2-clause", 9, 0.95, ("redistributions of source code",), r"redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd-4-clause", 9, 0.95, ("advertising materials",), r"all advertising materials mentioning features or use of this software"),
    ("bsd-2-clause", 7, 0.95, ("bsd",), r"\b(?:2|two) clause bsd\b|\bbsd 2 clause\b|\bsimplified bsd licen[sc]e\b|\bfreebsd licen[sc]e\b"),
    ("bsd-3-clause", 7, 0.95, ("bsd",), r"\b(?:3|three) clause bsd\b|\bbsd 3 clause\b|\b(?:new|revised|modified) bsd licen[sc]e\b"),
    ("bsd-4-clause", 7, 0.95, ("bsd",), r"\b(?:4|four) clause bsd\b|\bbsd 4 clause\b|\boriginal bsd licen[sc]e\b"),
    ("bsd", 5, 0.8, ("bsd",), r"\bbsd(?: style)? licen[sc]e\b"),
    ("bsd", 3, 0.6, ("bsd-licensed", "bsd licensed"), r"\bbsd licensed\b"),
    # Apache
    ("apache-2", 9, 0.99, ("apache.org/licenses/license-2.0",), r"\bapache\.org/licenses/license-2\.0\b"),
    ("apache-2", 7, 0.97, ("apache license", "apache licence"), r"\b(?:the )?apache licen[sc]e version 2(?:\.0)?\b"),
    ("apache-2", 7, 0.95, ("apache",), r"\bapache (?:licen[sc]e )?v?2(?:\.0)?\b"),
    ("apache-1.1", 7, 0.95, ("apache",), r"\bapache (?:software )?licen[sc]e version 1\.1\b"),
    ("apache-1.0", 7, 0.95, ("apache",), r"\bapache (?:software )?licen[sc]e version 1\.0\b"),
    ("apache", 5, 0.7, ("apache",), r"\bapache (?:software )?licen[sc]e\b"),
    ("apache", 3, 0.6, ("apache-licensed", "apache licensed"), r"\bapache licensed\b"),
    # GNU
    ("gpl-3-or-later", 9, 0.97, ("any later version",), r"general public license[^\n]{0,120}version 3[^\n]{0,80}any later version"),
    ("gpl-2-or-later", 9, 0.97, ("any later version",), r"general public license[^\n]{0,120}version 2[^\n]{0,80}any later version"),
    ("lgpl-3", 7, 0.95, ("lesser general public",), r"\blesser general public licen[sc]e version 3\b"),
    ("lgpl-2.1", 7, 0.95, ("lesser general public",), r"\blesser general public licen[sc]e version 2\.1\b"),
    ("lgpl-2", 7, 0.95, ("library general public",), r"\blibrary general public licen[sc]e version 2\b"),
    ("agpl-3", 7, 0.95, ("affero general public",), r"\baffero general public licen[sc]e version 3\b"),
    ("gpl-3", 7, 0.95, ("general public",), r"\bgeneral public licen[sc]e version 3\b"),
    ("gpl-2", 7, 0.95, ("general public",), r"\bgeneral public licen[sc]e version 2\b(?!\.1)"),
    ("gpl-1", 7, 0.95, ("general public",), r"\bgeneral public licen[sc]e version 1\b"),
    ("lgpl", 5, 0.8, ("lesser general public", "library general public"), r"\b(?:lesser|library) general public licen[sc]e\b"),
    ("agpl", 5, 0.8, ("affero general public",), r"\baffero general public licen[sc]e\b"),
    ("gpl", 4, 0.8, ("general public",), r"\bgnu general public licen[sc]e\b"),
    ("gpl-3-or-later", 7, 0.9, ("gpl",), r"\bgplv?3(?:\.0)?(?:\+| or later)"),
    ("gpl-2-or-later", 7, 0.9, ("gpl",), r"\bgplv?2(?:\.0)?(?:\+| or later)"),
    ("gpl-3", 6, 0.9, ("gpl",), r"(?<![al])\bgpl v?3(?:\.0)?\b|\bgplv?3(?:\.0)?\b"),
    ("gpl-2", 6, 0.9, ("gpl",), r"(?<![al])\bgpl v?2(?:\.0)?\b|\bgplv?2(?:\.0)?\b"),
    ("lgpl-3", 6, 0.9, ("lgpl",), r"\blgpl(?: v?|v)?3(?:\.0)?\b"),
    ("lgpl-2.1", 6, 0.9, ("lgpl",), r"\blgpl(?: v?|v)?2\.1\b"),
    ("agpl-3", 6, 0.9, ("agpl",), r"\bagpl(?: v?|v)?3(?:\.0)?\b"),
    ("gpl", 3, 0.5, ("gpl",), r"\bgpl licen[sc]ed?\b|\bgpled\b"),
    ("gfdl-1.3", 7, 0.95, ("free documentation",), r"\bfree documentation licen[sc]e version 1\.3\b"),
    ("gfdl-1.2", 7, 0.95, ("free documentation",), r"\bfree documentation licen[sc]e version 1\.2\b"),
    ("gfdl-1.1", 7, 0.95, ("free documentation",), r"\bfree documentation licen[sc]e version 1\.1\b"),
    ("gfdl", 5, 0.8, ("free documentation",), r"\bfree documentation licen[sc]e\b"),
    ("gcc-exception", 7, 0.9, ("runtime library exception",), r"\bgcc runtime library exception\b"),
    ("classpath-exception", 7, 0.9, ("classpath exception",), r"\bclasspath exception\b"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2", 9, 0.98, ("mozilla.org/mpl/2.0",), r"\bmozilla\.org/mpl/2\.0\b"),
    ("mpl-2", 7, 0.95, ("mozilla public",), r"\bmozilla public licen[sc]e version 2(?:\.0)?\b"),
    ("mpl-1.1", 7, 0.95, ("mozilla public",), r"\bmozilla public licen[sc]e version 1\.1\b"),
    ("mpl", 5, 0.8, ("mozilla public",), r"\bmozilla public licen[sc]e\b"),
    ("mpl-2", 6, 0.9, ("mpl",), r"\bmpl v?2(?:\.0)?\b"),
    ("mpl-1.1", 6, 0.9, ("mpl",), r"\bmpl v?1\.1\b"),
    ("epl-2", 7, 0.95, ("eclipse public",), r"\beclipse public licen[sc]e version 2(?:\.0)?\b|\beclipse public licen[sc]e v ?2(?:\.0)?\b"),
    ("epl-1", 7, 0.95, ("eclipse public",), r"\beclipse public licen[sc]e version 1(?:\.0)?\b|\beclipse public licen[sc]e v ?1(?:\.0)?\b"),
    ("epl", 5, 0.8, ("eclipse public",), r"\beclipse public licen[sc]e\b"),
    ("edl-1", 7, 0.9, ("eclipse distribution",), r"\beclipse distribution licen[sc]e\b"),
    ("cddl-1.1", 7, 0.95, ("common development and distribution",), r"\bcommon development and distribution licen[sc]e version 1\.1\b"),
    ("cddl-1", 7, 0.95, ("common development and distribution",), r"\bcommon development and distribution licen[sc]e version 1\.0\b"),
    ("cddl", 5, 0.8, ("common development and distribution", "cddl"), r"\bcommon development and distribution licen[sc]e\b|\bcddl\b"),
    ("cpl-1", 6, 0.9, ("common public",), r"\bcommon public licen[sc]e\b"),
    ("ipl-1", 6, 0.9, ("ibm public",), r"\bibm public licen[sc]e\b"),
    ("spl-1", 6, 0.9, ("sun public",), r"\bsun public licen[sc]e\b"),
    ("npl", 6, 0.9, ("netscape public",), r"\bnetscape public licen[sc]e\b"),
    ("eupl-1.2", 7, 0.95, ("european union public",), r"\beuropean union public licen[sc]e (?:version |v ?)?1\.2\b"),
    ("eupl-1.1", 7, 0.95, ("european union public",), r"\beuropean union public licen[sc]e (?:version |v ?)?1\.1\b"),
    ("eupl", 5, 0.8, ("european union public", "eupl"), r"\beuropean union public licen[sc]e\b|\beupl\b"),
    ("cecill-2.1", 7, 0.9, ("cecill",), r"\bcecill(?: licen[sc]e)?(?: version| v)? ?2\.1\b"),
    ("cecill-b", 7, 0.9, ("cecill",), r"\bcecill b\b"),
    ("cecill-c", 7, 0.9, ("cecill",), r"\bcecill c\b"),
    ("cecill", 5, 0.8, ("cecill",), r"\bcecill\b"),
    ("apsl-2", 6, 0.9, ("apple public source",), r"\bapple public source licen[sc]e\b"),
    ("qpl-1", 6, 0.9, ("q public", "qt public"), r"\bq(?:t)? public licen[sc]e\b"),
    ("ms-pl", 6, 0.9, ("microsoft public",), r"\bmicrosoft public licen[sc]e\b"),
    ("ms-rl", 6, 0.9, ("microsoft reciprocal",), r"\bmicrosoft reciprocal licen[sc]e\b"),
    ("osl-3", 6, 0.9, ("open software licen",), r"\bopen software licen[sc]e\b"),
    ("afl-3", 6, 0.9, ("academic free",), r"\bacademic free licen[sc]e\b"),
    ("ecl-2", 6, 0.9, ("educational community",), r"\beducational community licen[sc]e\b"),
    ("artistic-2", 7, 0.95, ("artistic",), r"\bartistic licen[sc]e (?:version )?2(?:\.0)?\b"),
    ("artistic-1", 7, 0.95, ("artistic",), r"\bartistic licen[sc]e (?:version )?1(?:\.0)?\b"),
    ("artistic", 5, 0.8, ("artistic",), r"\bartistic licen[sc]e\b"),
    ("perl", 6, 0.9, ("same terms as perl",), r"\bunder the same terms as perl(?: itself)?\b"),
    ("ruby", 6, 0.85, ("ruby",), r"\bruby licen[sc]e\b|\bruby s licen[sc]e\b"),
    ("php-3", 7, 0.9, ("php",), r"\bphp licen[sc]e(?: version)? 3(?:\.0[01]?)?\b"),
    ("php", 5, 0.8, ("php",), r"\bphp licen[sc]e\b"),
    ("python-2", 6, 0.9, ("python software foundation",), r"\bpython software foundation licen[sc]e\b"),
    ("psf", 5, 0.8, ("psf",), r"\bpsf licen[sc]e\b"),
    ("zpl-2.1", 6, 0.9, ("zope public",), r"\bzope public licen[sc]e\b"),
    ("w3c", 6, 0.9, ("w3c",), r"\bw3c software (?:notice and |and document )?licen[sc]e\b"),
    ("ofl-1.1", 7, 0.95, ("open font",), r"\bsil open font licen[sc]e(?: version)? 1\.1\b"),
    ("ofl", 5, 0.85, ("open font",), r"\bopen font licen[sc]e\b"),
    ("ubuntu-font", 6, 0.9, ("ubuntu font",), r"\bubuntu font licen[sc]e\b"),
    ("bsl-1", 9, 0.97, ("boost",), r"\bboost software licen[sc]e version 1\.0\b"),
    ("bsl-1", 5, 0.9, ("boost",), r"\bboost software licen[sc]e\b"),
    ("zlib", 9, 0.97, ("provided 'as-is'", "provided as-is"), r"this software is provided as is without any express or implied warranty"),
    ("zlib", 5, 0.9, ("zlib",), r"\bzlib(?: libpng)? licen[sc]e\b"),
    ("libpng", 5, 0.9, ("libpng",), r"\blibpng licen[sc]e\b"),
    ("openssl", 5, 0.9, ("openssl",), r"\bopenssl licen[sc]e\b"),
    ("curl", 5, 0.9, ("curl",), r"\bcurl licen[sc]e\b"),
    ("ncsa", 6, 0.9, ("ncsa",), r"\b(?:university of illinois )?ncsa open source licen[sc]e\b"),
    ("postgresql", 6, 0.9, ("postgresql",), r"\bpostgresql licen[sc]e\b"),
    ("unlicense", 9, 0.98, ("unencumbered",), r"free and unencumbered software released into the public domain"),
    ("unlicense", 5, 0.9, ("unlicense",), r"\bthe unlicense\b|\bunlicense\.org\b"),
    ("wtfpl", 5, 0.9, ("wtfpl", "what the fuck"), r"\bwtfpl\b|\bdo what the fuck you want to public licen[sc]e\b"),
    ("beerware", 5, 0.9, ("beerware", "beer-ware"), r"\bbeer ?ware licen[sc]e\b"),
    ("mulan-2", 6, 0.9, ("mulan",), r"\bmulan (?:psl|permissive software licen[sc]e)(?: v(?:ersion)? ?2)?\b"),
    ("upl-1", 6, 0.9, ("universal permissive",), r"\buniversal permissive licen[sc]e\b"),
    ("blueoak-1", 6, 0.9, ("blue oak",), r"\bblue oak model licen[sc]e\b"),
    ("vim", 5, 0.9, ("vim licen",), r"\bvim licen[sc]e\b"),
    ("latex-1.3c", 6, 0.9, ("latex project",), r"\blatex project public licen[sc]e\b"),
    ("hpnd", 6, 0.9, ("historical permission",), r"\bhistorical permission notice and disclaimer\b"),
    ("sspl-1", 6, 0.9, ("server side public",), r"\bserver side public licen[sc]e\b"),
    ("busl-1.1", 6, 0.9, ("business source",), r"\bbusiness source licen[sc]e\b"),
    ("elastic-2", 6, 0.9, ("elastic licen",), r"\belastic licen[sc]e\b"),
    ("commons-clause", 6, 0.9, ("commons clause",), r"\bcommons clause\b"),
    ("json", 6, 0.9, ("not evil",), r"\bshall be used for good not evil\b"),
    ("polyform", 6, 0.9, ("polyform",), r"\bpolyform (?:noncommercial|small business|strict|shield|perimeter|free trial) licen[sc]e\b"),
    # Creative Commons and data
    ("cc0-1", 9, 0.97, ("publicdomain/zero",), r"\bcreativecommons\.org/publicdomain/zero/1\.0\b"),
    ("cc0-1", 7, 0.95, ("cc0",), r"\bcc0(?: 1\.0)?(?: universal)?\b"),
    ("cc-pdm", 7, 0.9, ("public domain mark",), r"\bpublic domain mark\b"),
    ("public-domain", 5, 0.7, ("public domain",), r"\b(?:released|dedicated|placed) (?:in|in to|into|to) the public domain\b"),
    ("odbl-1", 7, 0.9, ("open database", "odbl"), r"\bopen database licen[sc]e\b|\bodbl\b"),
    ("odc-by-1", 7, 0.9, ("odc",), r"\bodc (?:by|attribution)\b"),
    ("pddl-1", 7, 0.9, ("pddl", "public domain dedication and licen"), r"\bpddl\b|\bpublic domain dedication and licen[sc]e\b"),
    ("cdla-permissive", 7, 0.9, ("cdla", "community data"), r"\bcdla permissive\b|\bcommunity data licen[sc]e agreement permissive\b"),
    ("cdla-sharing", 7, 0.9, ("cdla", "community data"), r"\bcdla sharing\b|\bcommunity data licen[sc]e agreement sharing\b"),
    ("ogl-uk-3", 7, 0.9, ("open government",), r"\bopen government licen[sc]e(?: v(?:ersion)? ?3(?:\.0)?)?\b"),
    ("etalab-2", 6, 0.9, ("licence ouverte",), r"\blicence ouverte\b"),
    ("dl-de-by-2", 6, 0.9, ("datenlizenz",), r"\bdatenlizenz deutschland\b"),
    # Models
    ("openrail", 6, 0.9, ("openrail", "open rail", "responsible ai licen"), r"\b(?:creativeml |bigscience |bigcode )?open ?rail(?: \+?\+?m)?\b|\bresponsible ai licen[sc]e\b"),
    ("llama-community", 6, 0.9, ("llama",), r"\bllama \d(?:\.\d)? community licen[sc]e\b"),
    ("gemma-terms", 6, 0.9, ("gemma",), r"\bgemma terms of use\b"),
    # Reservations
    ("all-rights-reserved", 4, 0.8, ("all rights reserved",), r"\ball rights reserved\b"),
    ("all-rights-reserved", 4, 0.7, ("alle rechte vorbehalten",), r"\balle rechte vorbehalten\b"),
    ("all-rights-reserved", 4, 0.7, ("tous droits r",), r"\btous droits r[ée]serv[ée]s\b"),
    ("all-rights-reserved", 4, 0.7, ("todos los derechos reservados",), r"\btodos los derechos reservados\b"),
    ("proprietary", 5, 0.8, ("proprietary and confidential", "confidential and proprietary"), r"\bproprietary and confidential\b|\bconfidential and proprietary\b"),
    ("proprietary", 4, 0.7, ("unauthorized", "unauthorised"), r"\bunauthori[sz]ed (?:copying|reproduction|use|distribution) (?:of this|is)\b"),
    ("no-license", 4, 0.7, ("no license", "no licence"), r"\bno licen[sc]e is (?:granted|given)\b"),
    ("non-commercial", 4, 0.7, ("non-commercial", "noncommercial", "non commercial"), r"\bnon ?commercial (?:use|purposes?) only\b"),
    ("research-only", 4, 0.7, ("research",), r"\bfor research (?:use|purposes) only\b"),
    ("evaluation-only", 4, 0.7, ("evaluation",), r"\bfor evaluation (?:use|purposes) only\b"),
    ("dual", 3, 0.5, ("dual",), r"\bdual licensed\b"),
    ("copyright-notice", 2, 0.3, ("copyright", "©", "c 19", "c 20"), r"(?:\bcopyright|\(c\)|©) ?(?:\(c\)|©)? ?(?:19|20)\d\d\b"),
    # Grants, notices and conditions in full
    ("mit", 9, 0.97, ("the above copyright notice and this permission",), r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 8, 0.9, ("terms of the mit licen",), r"\b(?:under|subject to) the terms of the mit licen[sc]e\b"),
    ("mit", 8, 0.9, ("opensource.org/licenses/mit",), r"\bopensource\.org/licenses/mit\b"),
    ("mit-0", 9, 0.95, ("deal in the software without restriction",), r"deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", 9, 0.95, ("shall not be used in advertising",), r"the name of [^.\n]{1,80} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", 8, 0.9, ("opensource.org/licenses/isc",), r"\bopensource\.org/licenses/isc\b"),
    ("isc", 8, 0.9, ("terms of the isc",), r"\bunder the terms of the isc licen[sc]e\b"),
    ("0bsd", 9, 0.95, ("permission to use",), r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd-3-clause", 9, 0.95, ("without specific prior written permission",), r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-2-clause", 8, 0.9, ("redistributions in binary form",), r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-4-clause", 9, 0.95, ("this product includes software developed",), r"this product includes software developed by the university of california"),
    ("bsd", 8, 0.8, ("governed by a bsd",), r"\buse of this source code is governed by a bsd style licen[sc]e that can be found in the licen[sc]e file\b"),
    ("bsd", 7, 0.8, ("terms of the bsd",), r"\bunder the terms of the bsd licen[sc]e\b"),
    ("bsd-3-clause-clear", 9, 0.95, ("no express or implied licenses to any party",), r"no express or implied licenses to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-protection", 6, 0.85, ("bsd protection",), r"\bbsd protection licen[sc]e\b"),
    ("apache-2", 9, 0.98, ("you may not use this file except in compliance",), r"licensed under the apache license version 2\.0 the license you may not use this file except in compliance with the license"),
    ("apache-2", 8, 0.9, ("unless required by applicable law or agreed",), r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 8, 0.9, ("terms of the apache",), r"\bunder the terms of the apache license(?: version)? 2(?:\.0)?\b"),
    ("apache-1.1", 9, 0.95, ("developed by the apache software foundation",), r"this product includes software developed by the apache software foundation"),
    ("gpl-2-or-later", 10, 0.98, ("redistribute it and", "redistribute it"), r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", 10, 0.98, ("redistribute it",), r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", 10, 0.98, ("lesser general public",), r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2\.1 of the license or at your option any later version"),
    ("lgpl-3-or-later", 10, 0.98, ("lesser general public",), r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2-or-later", 10, 0.98, ("library general public",), r"under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("agpl-3-or-later", 10, 0.98, ("affero general public",), r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", 8, 0.85, ("without even the implied warranty",), r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", 7, 0.85, ("received a copy of the gnu general public",), r"you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", 7, 0.85, ("received a copy of the gnu lesser general public",), r"you should have received a copy of the gnu lesser general public license along with this (?:library|program)"),
    ("agpl", 7, 0.85, ("received a copy of the gnu affero general public",), r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gpl", 7, 0.85, ("gnu.org/licenses/gpl",), r"\bgnu\.org/licenses/gpl(?:\.html|\.txt)?\b"),
    ("lgpl", 7, 0.85, ("gnu.org/licenses/lgpl",), r"\bgnu\.org/licenses/lgpl(?:\.html|\.txt)?\b"),
    ("agpl", 7, 0.85, ("gnu.org/licenses/agpl",), r"\bgnu\.org/licenses/agpl(?:\.html|\.txt)?\b"),
    ("gfdl-1.2", 10, 0.97, ("free documentation",), r"under the terms of the gnu free documentation license version 1\.2 or any later version published by the free software foundation"),
    ("gfdl-1.3", 10, 0.97, ("free documentation",), r"under the terms of the gnu free documentation license version 1\.3 or any later version published by the free software foundation"),
    ("gfdl-no-invariants", 9, 0.9, ("no invariant sections",), r"with no invariant sections no front cover texts and no back cover texts"),
    ("linux-syscall-note", 8, 0.9, ("user programs that use kernel services",), r"this copyright does \*?not\*? cover user programs that use kernel services by normal system calls"),
    ("openssl-exception", 8, 0.9, ("link the code of portions",), r"permission to link the code of portions of this program with the openssl library"),
    ("mpl-2", 10, 0.98, ("subject to the terms of the mozilla public",), r"this source code form is subject to the terms of the mozilla public license v 2\.0"),
    ("mpl-1.1", 10, 0.98, ("mozilla public license version 1.1",), r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2-no-copyleft", 9, 0.95, ("incompatible with secondary licenses",), r"this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2\.0"),
    ("epl-2", 10, 0.97, ("accompanying materials are made available",), r"this program and the accompanying materials are made available under the terms of the eclipse public license 2\.0"),
    ("epl-1", 10, 0.97, ("accompanying materials are made available",), r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2", 8, 0.9, ("eclipse.org/legal/epl-2.0", "eclipse.org/legal/epl-v20"), r"\beclipse\.org/legal/epl 2\.0\b|\beclipse\.org/legal/epl v20\b"),
    ("cddl", 9, 0.95, ("common development and distribution",), r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("npl", 9, 0.95, ("netscape public",), r"the contents of this file are subject to the netscape public license"),
    ("apsl-2", 9, 0.95, ("apple public source",), r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("eupl-1.2", 9, 0.95, ("licensed under the eupl",), r"\blicensed under the eupl(?: version)? 1\.2\b"),
    ("artistic-2", 9, 0.95, ("terms of the artistic",), r"under the terms of the artistic license 2\.0\b"),
    ("perl", 8, 0.9, ("redistribute it and", "same terms as perl"), r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("ruby", 8, 0.9, ("same terms as ruby",), r"\bunder the same terms as ruby\b"),
    ("php-3", 9, 0.95, ("subject to version 3", ), r"this source file is subject to version 3\.01 of the php license"),
    ("php", 8, 0.9, ("this product includes php",), r"this product includes php software freely available from"),
    ("python-2", 9, 0.95, ("psf hereby grants",), r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("zpl-2.1", 9, 0.95, ("subject to the provisions of the zope",), r"this software is subject to the provisions of the zope public license version 2\.1"),
    ("w3c", 9, 0.9, ("w3c",), r"this work is being provided by the copyright holders under the following licen[sc]e by obtaining and or copying this work you the licensee agree to w3c"),
    ("ofl-1.1", 9, 0.97, ("this font software is licensed under",), r"this font software is licensed under the sil open font license version 1\.1"),
    ("ofl-1.1", 8, 0.9, ("scripts.sil.org/ofl",), r"\bscripts\.sil\.org/ofl\b"),
    ("bsl-1", 10, 0.98, ("distributed under the boost",), r"distributed under the boost software license version 1\.0"),
    ("bsl-1", 9, 0.95, ("boost.org/license_1_0",), r"\bboost\.org/license 1 0\.txt\b"),
    ("zlib", 9, 0.95, ("altered source versions",), r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 9, 0.95, ("libpng version", "libpng licen"), r"\bthis code is released under the libpng licen[sc]e\b|\blibpng versions? [\d.]+ (?:through [\d.]+ )?(?:are|is) copyright\b"),
    ("openssl", 9, 0.95, ("openssl project for use",), r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 9, 0.95, ("eric young",), r"this product includes cryptographic software written by eric young"),
    ("curl", 9, 0.9, ("curl.se/docs/copyright", "curl.haxx.se/docs/copyright"), r"\bcurl\.(?:haxx\.)?se/docs/copyright\b"),
    ("ncsa", 9, 0.95, ("deal with the software without restriction",), r"to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("postgresql", 9, 0.95, ("without a written agreement",), r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("unlicense", 9, 0.95, ("anyone is free to copy modify",), r"anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("wtfpl", 9, 0.95, ("everyone is permitted to copy and distribute verbatim or modified",), r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document"),
    ("beerware", 9, 0.95, ("you can buy me a beer",), r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("cc0-1", 9, 0.97, ("waived all copyright",), r"waived all copyright and related or neighboring rights to"),
    ("cc-pdm", 9, 0.95, ("publicdomain/mark",), r"\bcreativecommons\.org/publicdomain/mark/1\.0\b"),
    ("cc-by-4.0", 9, 0.97, ("this work is licensed under a creative commons", "this work is licensed under the creative commons"), r"this work is licensed under (?:a|the) creative commons attribution 4\.0 international licen[sc]e"),
    ("cc-by-sa-4.0", 10, 0.97, ("this work is licensed under a creative commons",), r"this work is licensed under a creative commons attribution share ?alike 4\.0 international licen[sc]e"),
    ("cc-by-nc-4.0", 10, 0.97, ("this work is licensed under a creative commons",), r"this work is licensed under a creative commons attribution non ?commercial 4\.0 international licen[sc]e"),
    ("public-domain", 7, 0.8, ("in the public domain",), r"\bthis (?:work|file|code|software|document) is in the public domain\b"),
    ("public-domain", 7, 0.75, ("work of the united states government", "work of the u.s. government"), r"\bwork of the (?:united states|u\.s\.) government\b"),
    ("odbl-1", 9, 0.95, ("opendatacommons.org/licenses/odbl",), r"\bopendatacommons\.org/licenses/odbl\b"),
    ("odc-by-1", 9, 0.95, ("opendatacommons.org/licenses/by",), r"\bopendatacommons\.org/licenses/by\b"),
    ("pddl-1", 9, 0.95, ("opendatacommons.org/licenses/pddl",), r"\bopendatacommons\.org/licenses/pddl\b"),
    ("ogl-uk-3", 9, 0.95, ("contains public sector information",), r"contains public sector information licensed under the open government licence v3\.0"),
    ("etalab-2", 8, 0.9, ("etalab.gouv.fr",), r"\betalab\.gouv\.fr/licence ouverte\b"),
    ("llama-community", 9, 0.95, ("licensed under the llama",), r"\bllama \d(?:\.\d)? is licensed under the llama \d(?:\.\d)? community licen[sc]e\b"),
    ("openrail", 8, 0.9, ("use restrictions", "use-based restrictions"), r"\buse based restrictions as referenced in paragraph 5\b"),
    ("sspl-1", 9, 0.95, ("make the functionality of the program", "making the functionality of the program"), r"make the functionality of the program or a modified version available to third parties as a service|making the functionality of the program or modified version available to third parties as a service"),
    ("busl-1.1", 9, 0.95, ("change date", ), r"\bon the change date\b[^\n]{1,80}\bchange licen[sc]e\b"),
    ("elastic-2", 9, 0.95, ("hosted or managed service",), r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 9, 0.95, ("right to sell the software",), r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("all-rights-reserved", 4, 0.7, ("tutti i diritti riservati",), r"\btutti i diritti riservati\b"),
    ("all-rights-reserved", 4, 0.7, ("todos os direitos reservados",), r"\btodos os direitos reservados\b"),
    ("all-rights-reserved", 4, 0.7, ("alle rechten voorbehouden",), r"\balle rechten voorbehouden\b"),
    ("all-rights-reserved", 5, 0.8, ("no part of this",), r"\bno part of this (?:publication|book|work|document) may be reproduced\b"),
    ("proprietary", 6, 0.8, ("end user license agreement", "end user licence agreement"), r"\bend user licen[sc]e agreement\b"),
    ("proprietary", 5, 0.8, ("contains trade secrets", "contains confidential"), r"\bcontains (?:trade secrets|confidential information) of\b"),
    ("no-redistribution", 5, 0.75, ("may not be redistributed", "do not redistribute"), r"\bmay not be redistributed\b|\bdo not redistribute\b"),
    ("personal-use-only", 4, 0.7, ("personal use only",), r"\bfor personal use only\b"),
    ("no-derivatives", 4, 0.6, ("no derivative works",), r"\bno derivative works (?:are )?(?:permitted|allowed)\b"),
    ("share-alike", 4, 0.6, ("under the same license", "under the same licence"), r"\bdistribute your contributions under the same licen[sc]e\b"),
    ("no-ai-training", 6, 0.8, ("train", ), r"\b(?:may|must|shall) not be used (?:for|to) train(?:ing)? (?:any )?(?:artificial intelligence|machine learning|ai|language)\b"),
]

#: Creative Commons variants, each as short name, long name and address; the versions follow from the list.
_CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?derivatives", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?derivatives"}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
for _k, _long in _CC.items():
    _n = _k.count("-")
    RULES.append((f"cc-{_k}", 5 + _n, 0.85, ("cc by", "cc-by"), rf"\bcc {_k.replace('-', ' ')}\b"))
    RULES.append((f"cc-{_k}", 5 + _n, 0.9, ("creative commons",), rf"\bcreative commons {_long}\b"))
    for _v in _CC_VERSIONS:
        _e = re.escape(_v)
        RULES.append((f"cc-{_k}-{_v}", 7 + _n, 0.95, ("cc by", "cc-by"), rf"\bcc {_k.replace('-', ' ')} {_e}(?!\d)"))
        RULES.append((f"cc-{_k}-{_v}", 7 + _n, 0.97, ("creative commons",), rf"\bcreative commons {_long} {_e}(?!\d)"))
        RULES.append((f"cc-{_k}-{_v}", 9 + _n, 0.98, ("creativecommons.org",), rf"\bcreativecommons\.org/licenses/{_k}/{_e}"))
#: Identifiers after the machine-readable tag.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CDDL-1.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 0BSD OFL-1.1 Artistic-2.0 EUPL-1.2 PostgreSQL Python-2.0 NCSA WTFPL".split()
for _id in SPDX:
    RULES.append((_id.lower(), 10, 0.99, ("spdx-license-identifier",), rf"spdx-license-identifier:\s*{re.escape(_id.lower())}(?![\w.\-])"))


class Scanner:
    """Compiled rules; made once in every worker process."""

    def __init__(self, rules=RULES):
        import ahocorasick

        self.rules = [(label, pri, conf, re.compile(self._expand(rx))) for label, pri, conf, _, rx in rules]
        gates: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for k in r[3]:
                gates.setdefault(re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", k).strip() or k, []).append(i)
        self.words = ahocorasick.Automaton()
        for k, which in gates.items():
            self.words.add_word(k, which)
        self.words.make_automaton()

    @staticmethod
    def _expand(rx: str) -> str:
        # A blank followed by ? is an optional separator.
        return rx.replace(" ?", "(?:" + S + ")?").replace(" ", S)

    def detect(self, text: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, priority, confidence) of the detections that stay. ``text`` is lower-cased."""
        flat = text.translate(_FLAT)
        run = sorted({i for _, which in self.words.iter(_squeeze(flat)) for i in which})
        found = []
        for i in run:
            label, pri, conf, rx = self.rules[i]
            found += [(-pri, i, m.start(), m.end(), label, conf) for m in rx.finditer(text)]
        out: list[tuple[int, int, str, int, float]] = []
        # A rule's own matches are disjoint, so only those of the rules before it can hold them: of the
        # kept ones that start no later, the largest end decides.
        spans: list[tuple[int, int]] = []
        for _, matches in groupby(sorted(found), key=lambda x: x[:2]):
            starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
            for pri, _, s, e, label, conf in matches:
                k = bisect_right(starts, s)
                if not k or reach[k - 1] < e:
                    out.append((s, e, label, -pri, conf))
                    spans.append((s, e))
            spans.sort()
        return sorted(out)


_FLAT = {i: " " for i in range(128) if not chr(i).isalnum()}


def _squeeze(text: str) -> str:
    return " ".join(text.split(" ")) if "  " not in text else re.sub(" +", " ", text)


_scanner: Scanner | None = None


def scanner() -> Scanner:
    global _scanner
    if _scanner is None:
        _scanner = Scanner()
    return _scanner


#: Any text without one of these has no detection; the first pass is over a whole slice of texts.
def _kernel(b: pa.RecordBatch) -> pa.RecordBatch:
    w = W.split(b["text"], True, W.ALNUM)
    n, sc = w.n, scanner()
    h = w.hashes()
    rows: list[tuple] = [[] for _ in range(b.num_rows)]
    for phrase, label in BASE:
        p = W.split(pa.array([phrase]), True, W.ALNUM).hashes()
        at = np.flatnonzero(h[: max(0, len(h) - len(p) + 1)] == p[0])
        for j in range(1, len(p)):
            at = at[h[at + j] == p[j]]
        doc = np.searchsorted(w.ptr, at, "right") - 1
        inside = at + len(p) <= w.ptr[doc + 1]
        for d, x in zip(doc[inside].tolist(), (at - w.ptr[doc])[inside].tolist(), strict=True):
            rows[d].append((x, label))
    raw = w.data.tobytes()
    base, labels, score, first, last = [], [], [], [], []
    for i in range(b.num_rows):
        text = raw[w.text_at[i] : w.text_at[i + 1]].decode("utf-8", "replace")
        found = sc.detect(text)
        own = {x[1] for x in rows[i]}
        conf = {x: 0.95 for x in own}
        for _, _, label, _, c in found:
            conf[label] = max(c, conf.get(label, 0))
        miss = 1.0
        for c in conf.values():
            miss *= 1 - c
        at = [x[0] for x in rows[i]]
        first.append(min(at) if at else None)
        last.append(max(at) if at else None)
        base.append(",".join(sorted(own)))
        labels.append(",".join(sorted(conf)))
        score.append(min(1.0, max(0.0, 1 - miss)))
    return pa.RecordBatch.from_arrays(
        [b["doc_id"], pa.array(n.astype(np.int64)), pa.array([len(x) for x in rows], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_slices(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", schema, _kernel)


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
