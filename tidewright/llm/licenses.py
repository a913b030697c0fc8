"""License scans with ordered signature rules, in Spark expressions only.

A text is normalised to lower-case words (A-Z only). Rules are regular expressions over words, made from names of
licences and the forms in which they are granted. Three filters come before any of them: the text must hold one of few
stems, the rule's keyword must stand in the text, and only then its expression runs. Where detections overlap, one that
lies within another of higher priority is suppressed, as is a shorter one within a longer one of the same priority;
base phrases have the highest priority and always stay.

Everything is one projection over the documents: no shuffle, no Python.

Defined results: null, empty and word-less texts have 0 words, no places, empty labels and score 0; equal texts give
equal results; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are always reported, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licences: label, keyword that gates its rules and stands in all that they match, and expressions of its name over normalised words.
NAMES = (
    ("mit", "mit", r"mit"),
    ("mit", "expat", r"expat"),
    ("x11", "x11", r"x11"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)? (?:version |v )?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)? (?:version |v )?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)?(?: license)? (?:version |v )?1 0"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2(?: clause)?"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd|(?:new|revised|modified) bsd|bsd 3(?: clause)?"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd|original bsd|bsd 4(?: clause)?"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1.0", "boost", r"boost(?: software)?(?: license)?(?: version)?(?: 1 0)?"),
    ("gpl-1", "gpl", r"gpl (?:version |v )?1(?: 0)?|gplv1"),
    ("gpl-2", "gpl", r"gpl (?:version |v )?2(?: 0)?|gplv2"),
    ("gpl-3", "gpl", r"gpl (?:version |v )?3(?: 0)?|gplv3"),
    ("gpl-2", "general public", r"(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?"),
    ("gpl", "general public", r"gnu general public"),
    ("lgpl-2", "lgpl", r"lgpl (?:version |v )?2(?: 0)?|lgplv2"),
    ("lgpl-2.1", "lgpl", r"lgpl (?:version |v )?2 1|lgplv2 1"),
    ("lgpl-3", "lgpl", r"lgpl (?:version |v )?3(?: 0)?|lgplv3"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public"),
    ("lgpl", "library general", r"(?:gnu )?library general public"),
    ("agpl-3", "agpl", r"agpl (?:version |v )?3(?: 0)?|agplv3"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public(?: license)?(?: version 3)?"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)? (?:version |v )?1 1"),
    ("mpl-2", "mozilla", r"mozilla public(?: license)? (?:version |v )?2(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl (?:version |v )?1 1"),
    ("mpl-2", "mpl", r"mpl (?:version |v )?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public(?: license)? (?:version |v )?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public(?: license)? (?:version |v )?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl-1", "cddl", r"cddl(?: (?:version |v )?1(?: 0)?)?"),
    ("cddl-1", "common development", r"common development and distribution"),
    ("eupl", "eupl", r"eupl(?: (?:version |v )?1 [0-2])?"),
    ("eupl", "european union public", r"european union public"),
    ("artistic-1", "artistic", r"artistic(?: license)? (?:version |v )?1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: license)? (?:version |v )?2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("python-2", "python", r"python software foundation(?: license)?(?: version 2)?"),
    ("python-2", "psf", r"psf"),
    ("php-3", "php", r"php(?: license)? (?:version |v )?3(?: 0[01])?"),
    ("ruby", "ruby", r"ruby"),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"unlicense"),
    ("openssl", "openssl", r"openssl(?: ssleay)?"),
    ("ofl-1.1", "sil open font", r"sil open font(?: license)?(?: (?:version |v )?1 1)?"),
    ("ofl-1.1", "ofl", r"ofl(?: 1 1)?"),
    ("ms-pl", "microsoft public", r"microsoft public"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("afl-3", "academic free", r"academic free(?: license)?(?: (?:version |v )?3(?: 0)?)?"),
    ("osl-3", "open software", r"open software(?: license)?(?: (?:version |v )?3(?: 0)?)?"),
    ("odbl-1", "open database", r"open database(?: license)?(?: 1 0)?"),
    ("odbl-1", "odbl", r"odbl(?: 1 0)?"),
    ("odc-by-1", "open data commons", r"open data commons attribution"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation"),
    ("vim", "vim", r"vim"),
    ("sspl-1", "server side public", r"server side public"),
    ("sspl-1", "sspl", r"sspl(?: 1(?: 0)?)?"),
    ("busl-1.1", "business source", r"business source(?: license)?(?: 1 1)?"),
    ("elastic-2", "elastic", r"elastic(?: license)? (?:version |v )?2(?: 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by sa", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by nc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported)?"),
)
#: Forms of a grant: priority after the base (1 first), weight in the score, and the expression around a name.
FORMS = (
    (1, 0.95, r"(?:licensed|released|distributed|available|published|provided|covered)(?: under| by| with)(?: the)?(?: terms(?: and conditions)? of(?: the)?)? (?:{})(?: licen[sc]e)?"),
    (2, 0.9, r"spdx license identifier (?:{})(?: only| or later)?"),
    (3, 0.8, r"(?:{})(?: public)? licen[sc]e"),
)
#: Names that say enough without a form.
PLAIN = ("cc0", "cc by", "cc by sa", "cc by nd", "cc by nc", "cc by nc sa", "cc by nc nd", "creative commons", "general public", "gpl", "lgpl", "agpl", "wtfpl")
#: Statements without a licence name: label, keyword, weight, expression.
STATEMENTS = (
    ("all-rights-reserved", "all rights reserved", 0.6, r"all rights reserved"),
    ("copyright", "copyright", 0.4, r"copyright (?:c )?(?:19|20)[0-9][0-9]"),
    ("public-domain", "public domain", 0.7, r"(?:in|into|to) the public domain"),
    ("proprietary", "proprietary", 0.6, r"proprietary and confidential|confidential and proprietary"),
    ("mit", "permission is hereby granted", 0.9, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", 0.9, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "apache org licenses", 0.9, r"apache org licenses license 2 0"),
    ("gpl", "gnu org licenses", 0.8, r"gnu org licenses(?: (?:gpl|lgpl|agpl))?(?: html)?"),
    ("cc", "creativecommons org", 0.7, r"creativecommons org licenses [a-z]+(?: [a-z]+)?(?: [a-z]+)?"),
    ("no-warranty", "without warranty", 0.3, r"without warranty of any kind"),
    ("mit", "substantial portions", 0.9, r"copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "rights to use copy modify merge", 0.9, r"rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "authors or copyright holders", 0.7, r"in no event shall the authors or copyright holders be liable"),
    ("mit", "mit x11", 0.9, r"mit x11 licen[sc]e"),
    ("mit-0", "mit no attribution", 0.9, r"mit no attribution licen[sc]e"),
    ("mit-modern", "modern variant", 0.9, r"mit licen[sc]e modern variant|mit modern variant licen[sc]e"),
    ("x11", "x consortium", 0.8, r"name of the x consortium shall not be used in advertising or otherwise to promote the sale(?: [a-z0-9]+){0,10} without prior written permission"),
    ("bsd", "source code must retain", 0.8, r"redistributions? of source code must retain the (?:above )?copyright notice"),
    ("bsd", "binary form must reproduce", 0.8, r"redistributions? in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3", "endorse or promote products", 0.9, r"neither the names? of(?: [a-z0-9]+){1,12} may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "advertising materials", 0.9, r"all advertising materials mentioning features or use of this software must display the following (?:acknowledgement|acknowledgment)(?: [a-z0-9]+){0,6} copyright"),
    ("bsd", "copyright holders and contributors", 0.7, r"provided by the copyright holders and contributors as is"),
    ("bsd-0", "zero clause bsd", 0.9, r"zero clause bsd licen[sc]e"),
    ("bsd-0", "0bsd", 0.9, r"0bsd licen[sc]e|licen[sc]e 0bsd"),
    ("isc", "above copyright notice and this permission notice appear", 0.9, r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "internet systems consortium", 0.7, r"copyright (?:c )?(?:[0-9]{4} )*(?:by )?internet systems consortium"),
    ("zlib", "origin of this software", 0.9, r"origin of this software must not be misrepresented"),
    ("zlib", "provided as is without any express", 0.7, r"provided as is without any express or implied warranty"),
    ("zlib", "altered source versions", 0.8, r"permission is granted to anyone to use this software for any purpose(?: [a-z0-9]+){0,20} altered source versions"),
    ("apache-2", "limitations under the license", 0.9, r"license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "in compliance with the license", 0.8, r"you may not use this file except in compliance with the license"),
    ("apache-2", "as is basis", 0.8, r"distributed under the license is distributed on an as is basis"),
    ("apache-2", "contributor license agreements", 0.8, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "grant of patent license", 0.8, r"grant of patent license subject to the terms and conditions of this license"),
    ("apache-2", "apache software license", 0.8, r"the apache software license(?: version)? 2(?: 0)?"),
    ("apache-1.1", "developed by the apache software foundation", 0.8, r"includes software developed by the apache software foundation(?: [a-z0-9]+){0,10} licen[sc]e"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu", 0.9, r"redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl", "should have received a copy of the gnu general public", 0.9, r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl-2", "version 2 of the license", 0.9, r"either version 2 of the license or at your option any later version"),
    ("gpl-3", "version 3 of the license", 0.9, r"either version 3 of the license or at your option any later version"),
    ("gpl-2", "gnu gpl", 0.8, r"gnu gpl (?:version |v )?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gnu gpl", 0.8, r"gnu gpl (?:version |v )?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gnu gpl", 0.8, r"gnu gpl"),
    ("gpl", "copyleft", 0.4, r"copyleft licen[sc]e"),
    ("gpl-classpath", "classpath exception", 0.9, r"gpl(?: version)?(?: 2(?: 0)?)? with(?: the)? classpath exception"),
    ("gpl-linking", "special exception", 0.7, r"as a special exception the copyright holders?(?: [a-z0-9]+){0,6} give you permission to link"),
    ("gpl-runtime", "runtime library exception", 0.9, r"gcc runtime library exception(?: version 3 1)?(?: [a-z0-9]+){0,6} licen[sc]e"),
    ("gpl-font", "font exception", 0.9, r"gpl (?:with )?font exception"),
    ("lgpl", "should have received a copy of the gnu lesser", 0.9, r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", "terms of the gnu lesser", 0.9, r"redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("lgpl-2", "terms of the gnu library", 0.9, r"redistribute it and or modify it under the terms of the gnu library general public licen[sc]e"),
    ("lgpl-2.1", "gnu lgpl", 0.8, r"gnu lgpl (?:version |v )?2 1"),
    ("lgpl-3", "gnu lgpl", 0.8, r"gnu lgpl (?:version |v )?3(?: 0)?"),
    ("agpl-3", "should have received a copy of the gnu affero", 0.9, r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("agpl-3", "gnu agpl", 0.8, r"gnu agpl(?: (?:version |v )?3(?: 0)?)?"),
    ("agpl-3", "interacting with it remotely", 0.8, r"users interacting with it remotely through a computer network(?: [a-z0-9]+){0,26} available"),
    ("mpl-2", "subject to the terms of the mozilla", 0.9, r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? 2 0"),
    ("mpl-2", "mozilla org mpl", 0.8, r"copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org mpl", 0.8, r"contents of this file are subject to the mozilla public licen[sc]e version 1 1(?: [a-z0-9]+){0,20} mozilla org mpl"),
    ("mpl-1.1", "original code is", 0.5, r"the original code is (?:[a-z0-9]+ ){0,8}released"),
    ("epl-2", "eclipse org legal", 0.8, r"made available under the terms of the eclipse public licen[sc]e 2 0(?: [a-z0-9]+){0,10} eclipse org legal epl"),
    ("epl-1", "eclipse org legal", 0.8, r"made available under the terms of the eclipse public licen[sc]e v1 0(?: [a-z0-9]+){0,10} eclipse org legal epl"),
    ("edl-1", "eclipse distribution", 0.8, r"eclipse distribution licen[sc]e(?: v(?:ersion)? ?1 0)?"),
    ("cddl-1", "opensource org licenses cddl", 0.8, r"opensource org licenses cddl(?: ?1(?: 0)?)?"),
    ("cpl-1", "common public license", 0.8, r"common public license(?: version)?(?: v)? ?1(?: 0)?"),
    ("cpal-1", "common public attribution", 0.8, r"common public attribution licen[sc]e(?: version)?(?: 1(?: 0)?)?"),
    ("ipl-1", "ibm public license", 0.8, r"ibm public license(?: version)?(?: v)?(?: ?1(?: 0)?)?"),
    ("spl-1", "sun public license", 0.8, r"sun public license(?: version)?(?: v)?(?: ?1(?: 0)?)?"),
    ("npl-1.1", "netscape public license", 0.8, r"netscape public license(?: version)?(?: 1(?: [01])?)?"),
    ("qpl-1", "q public license", 0.8, r"q public license(?: version)?(?: 1(?: 0)?)?"),
    ("apsl-2", "apple public source", 0.8, r"apple public source licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("ms-pl", "ms pl", 0.7, r"ms pl licen[sc]e"),
    ("nasa-1.3", "nasa open source", 0.8, r"nasa open source agreement(?: version)?(?: 1 3)?(?: [a-z0-9]+){0,6} licen[sc]e"),
    ("cecill-2", "cecill", 0.8, r"cecill(?: free software)? licen[sc]e(?: agreement)?(?: version)?(?: 2(?: [01])?)?"),
    ("cecill-b", "cecill b", 0.8, r"cecill b(?: free software)? licen[sc]e"),
    ("cecill-c", "cecill c", 0.8, r"cecill c(?: free software)? licen[sc]e"),
    ("upl-1", "universal permissive", 0.8, r"universal permissive licen[sc]e(?: v(?:ersion)?)?(?: ?1(?: 0)?)?"),
    ("mulan-2", "mulan", 0.8, r"mulan psl(?: v2)? licen[sc]e|mulan permissive software licen[sc]e(?: v2)?"),
    ("blueoak-1", "blue oak model", 0.8, r"blue oak model licen[sc]e(?: 1(?: 0)?(?: 0)?)?"),
    ("parity-7", "parity public license", 0.8, r"parity public license(?: 7(?: 0)?(?: 0)?)?"),
    ("polyform", "polyform", 0.8, r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) licen[sc]e(?: 1(?: 0)?(?: 0)?)?"),
    ("commons-clause", "commons clause", 0.8, r"commons clause licen[sc]e(?: condition)?(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("hippocratic", "hippocratic", 0.8, r"hippocratic licen[sc]e(?: (?:version )?[1-3](?: [0-9])?)?"),
    ("json", "good not evil", 0.7, r"shall be used for good not evil(?: [a-z0-9]+){0,13} (?:software is provided|licen[sc]e)"),
    ("beerware", "beer ware", 0.8, r"beer ware licen[sc]e(?: revision 42)?"),
    ("beerware", "beerware", 0.8, r"beerware licen[sc]e(?: revision 42)?"),
    ("wtfpl", "do what the", 0.8, r"do what the f[a-z]+ you want to public licen[sc]e(?: version 2)?"),
    ("unlicense", "free and unencumbered", 0.9, r"free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", 0.8, r"https? unlicense org"),
    ("cc0-1.0", "public domain dedication", 0.8, r"(?:cc0 )?public domain dedication"),
    ("cc0-1.0", "creativecommons org publicdomain", 0.9, r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-4", "creativecommons org licenses by", 0.9, r"creativecommons org licenses by 4 0"),
    ("cc-by-3", "creativecommons org licenses by", 0.9, r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4", "creativecommons org licenses by sa", 0.9, r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3", "creativecommons org licenses by sa", 0.9, r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4", "creativecommons org licenses by nc", 0.9, r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4", "creativecommons org licenses by nd", 0.9, r"creativecommons org licenses by nd 4 0"),
    ("odbl-1", "opendatacommons org licenses odbl", 0.9, r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by-1", "opendatacommons org licenses by", 0.9, r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl-1", "opendatacommons org licenses pddl", 0.9, r"opendatacommons org licenses pddl(?: 1 0)?"),
    ("pddl-1", "public domain dedication and license", 0.8, r"(?:open data commons )?public domain dedication and license"),
    ("ogl-3", "open government licence", 0.8, r"open government licence(?: (?:version |v )?[123](?: 0)?)?"),
    ("gfdl", "permission is granted to copy distribute and or modify this document", 0.9, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("ofl-1.1", "scripts sil org", 0.8, r"scripts sil org ofl(?: [a-z0-9]+){0,6} licen[sc]e|licen[sc]e(?: [a-z0-9]+){0,10} scripts sil org ofl"),
    ("bitstream-vera", "bitstream vera", 0.8, r"bitstream vera (?:is a trademark of bitstream inc )?(?: [a-z0-9]+){0,6} (?:copyright|permission)"),
    ("ubuntu-font", "ubuntu font", 0.8, r"ubuntu font licen[sc]e(?: version)?(?: 1(?: 0)?)?"),
    ("openrail", "openrail", 0.8, r"(?:creativeml |bigscience )?open ?rail(?: m)? licen[sc]e"),
    ("bigcode-openrail", "bigcode open rail", 0.8, r"bigcode open rail m(?: v1)? licen[sc]e(?: agreement)?"),
    ("llama", "llama", 0.7, r"llama (?:[1-4] )?(?:[0-9] )?community licen[sc]e(?: agreement)?"),
    ("gemma", "gemma", 0.7, r"gemma terms of use(?: [a-z0-9]+){0,10} licen[sc]e"),
    ("curl", "curl", 0.6, r"curl licen[sc]e"),
    ("ijg", "independent jpeg group", 0.7, r"independent jpeg group s? ?licen[sc]e"),
    ("libpng", "libpng", 0.7, r"libpng licen[sc]e(?: version)?(?: 2)?"),
    ("libtiff", "libtiff", 0.7, r"libtiff licen[sc]e"),
    ("icu", "icu", 0.6, r"icu licen[sc]e"),
    ("unicode", "unicode", 0.6, r"unicode(?: inc)? licen[sc]e(?: agreement)?(?: v3)?"),
    ("naist", "nara institute", 0.6, r"nara institute of science and technology(?: [a-z0-9]+){0,10} (?:copyright|licen[sc]e)"),
    ("ntp", "ntp", 0.6, r"ntp licen[sc]e"),
    ("tcl", "tcl", 0.6, r"tcl (?:tk )?licen[sc]e"),
    ("sleepycat", "sleepycat", 0.7, r"sleepycat licen[sc]e"),
    ("lppl-1.3", "latex project public", 0.8, r"latex project public licen[sc]e(?: (?:version )?1 3[abc]?)?"),
    ("ecl-2", "educational community", 0.8, r"educational community licen[sc]e(?: version)?(?: 2(?: 0)?)?"),
    ("rpl-1.5", "reciprocal public license", 0.8, r"reciprocal public license(?: version)?(?: 1 [15])?"),
    ("oclc-2", "oclc research", 0.7, r"oclc research public licen[sc]e(?: 2(?: 0)?)?"),
    ("zpl-2.1", "zope public", 0.8, r"zope public licen[sc]e(?: zpl)?(?: version)?(?: 2(?: [01])?)?"),
    ("eula", "end user license agreement", 0.5, r"end user license agreement"),
    ("proprietary", "may not be reproduced", 0.6, r"may not be reproduced(?: [a-z0-9]+){0,13} without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent of the copyright)"),
    ("proprietary", "internal use only", 0.5, r"licensed for internal use only"),
    ("proprietary", "unauthorized copying", 0.6, r"unauthorized copying of this file(?: [a-z0-9]+){0,10} prohibited proprietary"),
    ("proprietary", "commercial license", 0.5, r"(?:requires|under|purchase) a commercial license"),
    ("source-available", "source available license", 0.6, r"source available license"),
    ("dual", "dual licensed", 0.5, r"dual licensed under"),
    ("dual", "your choice of", 0.5, r"at your choice of (?:the )?(?:[a-z0-9]+ ){1,8}licen[sc]e"),
    ("no-warranty", "merchantability", 0.3, r"implied warranty of merchantability(?: or| and)? fitness for a particular purpose"),
    ("no-warranty", "warranties of merchantability", 0.3, r"permission(?: [a-z0-9]+){0,33} warranties of merchantability"),
    ("no-liability", "consequential damages", 0.3, r"copyright (?:holder|owner)s? (?:or contributors )?be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("copyright", "copyright", 0.4, r"copyright notice"),
    ("copyright", "copyrighted by", 0.4, r"copyrighted by"),
)
#: One of these stands in every text that any rule can match.
STEMS = (
    "licen", "copyright", "gpl", "wtfpl", "cc by", "cc0", "creative", "public", "rights reserved", "proprietary", "permission", "redistribution", "warranty", "released",
    "distributed", "available", "published", "provided", "covered", "misrepresented",
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression over words, priority, weight), in the order of priority."""
    out = [(label, phrase, re.escape(phrase).replace("\\ ", " "), 0, 1.0) for phrase, label in BASE]
    for priority, weight, form in FORMS:
        out += [(label, keyword, form.replace("{}", name), priority, weight) for label, keyword, name in NAMES]
    out += [(label, keyword, name, 4, 0.7) for label, keyword, name in NAMES if keyword in PLAIN]
    out += [(label, keyword, expression, 4, weight) for label, keyword, weight, expression in STATEMENTS]
    return sorted(out, key=lambda r: r[3])


SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


#: Set before and after a match; a normalised text holds no such characters.
_FROM, _TO = "\x01", "\x02"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once: an array of one binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _places(padded: Column, expression: Column) -> Column:
    """Array of (start, end) word numbers where the expression matches whole words of `` w0 w1 ... ``. Matches are marked
    in the text, and the numbers of marked words are read off one split, so the cost grows with the text alone."""
    marked = F.regexp_replace(padded, F.concat(F.lit(" ((?:"), expression, F.lit("))(?= )")), F.lit(f" {_FROM}$1{_TO}"))
    numbers = lambda words, holds: F.array_compact(F.transform(words, lambda w, i: F.when(holds(w), i)))
    zipped = lambda p: F.transform(p["a"], lambda a, k: F.struct((a - 1).alias("start"), F.get(p["b"], k).alias("end")))

    def read(words: Column) -> Column:
        both = F.struct(numbers(words, lambda w: F.startswith(w, F.lit(_FROM))).alias("a"), numbers(words, lambda w: F.endswith(w, F.lit(_TO))).alias("b"))
        return _bound(both, zipped)

    none = F.array().cast("array<struct<start:int,end:int>>")
    return _bound(marked, lambda m: F.when(F.contains(m, F.lit(_FROM)), _bound(F.split(m, " "), read)).otherwise(none))


def detections(padded: Column) -> Column:
    """Array of (start, end, label, priority, weight) of all rules whose keyword stands in the text."""
    table = F.array(
        *(
            F.struct(F.lit(a).alias("label"), F.lit(b).alias("keyword"), F.lit(c).alias("rule"), F.lit(d).alias("priority"), F.lit(e).alias("weight"))
            for a, b, c, d, e in rules()
        )
    )
    possible = F.filter(table, lambda r: F.contains(padded, r["keyword"]))

    def run(r: Column) -> Column:
        return F.transform(
            _places(padded, r["rule"]),
            lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["weight"].alias("weight")),
        )

    return F.flatten(F.transform(possible, run))


#: Detections that are compared with each other at once.
CHUNK = 64


def _unsuppressed(found: Column) -> Column:
    """The detections that no other holds which is stronger, or as strong and longer. Many are sorted and cut into chunks
    of about the square root of their number, each compared only with detections that overlap it."""

    def kept(some: Column, near: Column) -> Column:
        def covered(d: Column) -> Column:
            return F.exists(
                near,
                lambda o: (o["start"] <= d["start"]) & (o["end"] >= d["end"])
                & ((o["priority"] < d["priority"]) | ((o["priority"] == d["priority"]) & (o["end"] - o["start"] > d["end"] - d["start"]))),
            )

        return F.filter(some, lambda d: (d["priority"] == 0) | ~covered(d))

    def in_chunks(ordered: Column) -> Column:
        size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(ordered))).cast("int"))

        def chunk(k: Column) -> Column:
            def against(some: Column) -> Column:
                first, last = F.element_at(some, 1)["start"], F.element_at(some, -1)["start"]
                return _bound(F.filter(ordered, lambda o: (o["start"] <= last) & (o["end"] > first)), lambda near: kept(some, near))

            return _bound(F.slice(ordered, k * size + 1, size), against)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / size).cast("int")), chunk))

    return F.when(F.size(found) <= CHUNK, kept(found, found)).otherwise(_bound(F.array_sort(found), in_chunks))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, found): all detections that aren't suppressed, as (start, end, label, priority, weight)."""
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SEPARATORS, " "))
    norm = df.select(F.col(id_col).alias("doc_id"), words.alias("norm"))
    n_words = F.when(F.col("norm") == "", F.lit(0)).otherwise(_spaces(F.col("norm")) + 1).cast("long")
    low = F.lower("norm")  # a wider fold than A-Z, for the gate alone
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains(F.concat(low, F.lit(" ")), F.lit(stem))
    padded = F.when(gate, F.concat(F.lit(" "), F.translate("norm", _UPPER, _LOWER), F.lit(" ")))
    gated = norm.select("doc_id", n_words.alias("n_words"), padded.alias("padded"))
    none = F.array().cast("array<struct<start:int,end:int,label:string,priority:int,weight:double>>")
    some = gated.select("doc_id", "n_words", F.when(F.col("padded").isNull(), none).otherwise(detections(F.col("padded"))).alias("found"))
    return some.select("doc_id", "n_words", _unsuppressed(F.col("found")).alias("found"))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("found", lambda d: d["priority"] == 0)
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    starts = F.transform(base, lambda d: d["start"].cast("long"))
    return scan(df, id_col, text_col).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
