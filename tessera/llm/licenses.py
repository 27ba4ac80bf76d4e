"""License scan by ordered signature rules.

Texts are normalised to lower-case words joined by one space. Hundreds of hand-written regexes
(names of licenses in the frames in which they are stated, and sentences of license texts) run only
where their keyword occurs. Every match
is an interval of words with the rule's priority. A detection inside an equally long or
longer one of better priority, or inside a longer one of the same priority, is suppressed,
so "GNU Lesser General Public License" does not also report the GPL.

The base phrases are counted apart and are never suppressed. Defined results: a null or
empty text has no words, no labels and score 0; repeated rows are scanned each; no part of
a text is skipped; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import alnum_words, let

#: The base phrases and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Label, regex of the name in normalised words, keywords of which every match holds one.
NAMES = (
    ("mit", "(?:mit|expat|x11)", "mit|expat|x11"),
    ("apache-2.0", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache"),
    ("apache", "apache(?: software)?", "apache"),
    ("agpl-3.0", "(?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)?", "affero|agpl"),
    ("agpl", "(?:gnu )?(?:affero general public license|agpl)", "affero|agpl"),
    ("lgpl-2.1", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?2 1", "lesser general|lgpl"),
    ("lgpl-3.0", "(?:gnu )?(?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)?", "lesser general|lgpl"),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", "lesser general|library general|lgpl"),
    ("gpl-2.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?2(?: 0)?", "general public|gpl"),
    ("gpl-3.0", "(?:gnu )?(?:general public license|gpl)(?: version| v)? ?3(?: 0)?", "general public|gpl"),
    ("gpl", "(?:gnu )?(?:general public license|gpl)", "general public|gpl"),
    ("gfdl", "(?:gnu )?(?:free documentation license|gfdl)", "free documentation|gfdl"),
    ("bsd-2-clause", "(?:(?:bsd )?(?:2|two) clause bsd|simplified bsd|freebsd|bsd (?:2|two) clause)", "bsd"),
    ("bsd-3-clause", "(?:(?:3|three) clause bsd|new bsd|modified bsd|revised bsd|bsd (?:3|three) clause)", "bsd"),
    ("bsd-4-clause", "(?:(?:4|four) clause bsd|original bsd|old bsd|bsd (?:4|four) clause)", "bsd"),
    ("bsd", "(?:berkeley software distribution|bsd)", "berkeley|bsd"),
    ("isc", "(?:isc|internet systems consortium)", "isc|internet systems"),
    ("mpl-1.1", "(?:mozilla public license|mpl)(?: version| v)? 1 1", "mozilla|mpl"),
    ("mpl-2.0", "(?:mozilla public license|mpl)(?: version| v)? 2(?: 0)?", "mozilla|mpl"),
    ("mpl", "(?:mozilla public|mpl)", "mozilla|mpl"),
    ("epl-1.0", "(?:eclipse public license|epl)(?: version| v)? 1(?: 0)?", "eclipse|epl"),
    ("epl-2.0", "(?:eclipse public license|epl)(?: version| v)? 2(?: 0)?", "eclipse|epl"),
    ("epl", "(?:eclipse public|epl)", "eclipse|epl"),
    ("cddl", "(?:common development and distribution|cddl)", "common development|cddl"),
    ("cpl-1.0", "common public", "common public"),
    ("eupl", "(?:european union public|eupl)", "european union|eupl"),
    ("artistic-2.0", "artistic(?: license)? 2(?: 0)?", "artistic"),
    ("artistic", "(?:perl )?artistic", "artistic"),
    ("boost-1.0", "boost(?: software)?", "boost"),
    ("zlib", "(?:zlib(?: libpng)?|libpng)", "zlib|libpng"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "wtfpl|do what the"),
    ("cc0-1.0", "(?:creative commons zero|cc0)(?: 1 0)?(?: universal)?", "creative commons|cc0"),
    ("cc-by-4.0", "(?:creative commons attribution|cc by) 4 0(?: international)?", "creative commons|cc by"),
    ("cc-by-3.0", "(?:creative commons attribution|cc by) 3 0(?: unported)?", "creative commons|cc by"),
    ("cc-by-sa-4.0", "(?:creative commons attribution share ?alike|cc by sa) 4 0(?: international)?", "creative commons|cc by"),
    ("cc-by-sa-3.0", "(?:creative commons attribution share ?alike|cc by sa) 3 0(?: unported)?", "creative commons|cc by"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)", "creative commons|cc by"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)", "creative commons|cc by"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:s|atives)?|cc by nc nd)", "creative commons|cc by"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)", "creative commons|cc by"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:s|atives)?|cc by nd)", "creative commons|cc by"),
    ("cc-by", "(?:creative commons attribution|cc by)", "creative commons|cc by"),
    ("cc", "creative commons", "creative commons"),
    ("odbl", "(?:open database|odbl)", "open database|odbl"),
    ("ofl-1.1", "(?:sil )?(?:open font|ofl)", "open font|ofl"),
    ("osl-3.0", "(?:open software|osl)", "open software|osl"),
    ("afl-3.0", "(?:academic free|afl)", "academic free|afl"),
    ("ms-pl", "(?:microsoft public|ms pl)", "microsoft|ms pl"),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)", "microsoft|ms rl"),
    ("python-2.0", "(?:python software foundation|psf)", "python|psf"),
    ("ruby", "ruby", "ruby"),
    ("php-3.01", "php", "php"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("vim", "vim", "vim"),
    ("tex-lppl", "(?:latex project public|lppl)", "latex|lppl"),
    ("ncsa", "(?:university of illinois ncsa|illinois ncsa|ncsa)", "ncsa"),
    ("unicode", "unicode(?: inc)?", "unicode"),
    ("w3c", "w3c(?: software)?(?: and document)?", "w3c"),
    ("beerware", "beer ?ware", "beerware|beer ware"),
    ("sspl", "(?:server side public|sspl)", "server side|sspl"),
    ("busl-1.1", "(?:business source|busl)", "business source|busl"),
    ("elastic-2.0", "elastic", "elastic"),
    ("upl-1.0", "(?:universal permissive|upl)", "universal permissive|upl"),
    ("mulan-2.0", "mulan(?: permissive)?(?: software)?", "mulan"),
    ("proprietary", "(?:proprietary|commercial)", "proprietary|commercial"),
)

#: Name of the frame, regex around a name, priority (less is better), confidence.
FRAMES = (
    (
        "statement",
        "(?:spdx license identifier |(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed) under (?:the |an? )?(?:terms of (?:the |an? )?)?"
        "|subject to (?:the )?(?:terms of (?:the )?)?)(?:@)(?: license)?",
        0,
        0.95,
    ),
    ("named", "@ licen[cs]e", 2, 0.8),
    ("field", "licen[cs]e (?:is |type )?(?:the )?@", 3, 0.7),
)
#: Names that are also everyday or product words: a bare field before them says nothing.
COMMON = frozenset("ruby php-3.01 vim postgresql openssl elastic-2.0 boost-1.0 unicode artistic python-2.0 zlib w3c proprietary mulan-2.0 isc".split())

#: Sentences that name no license or stand in its text: label, regex, keyword, confidence.
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 0.95),
    ("mit", "to deal in the software without restriction including without limitation", "to deal in the software", 0.9),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission notice shall be included", 0.9),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim", "authors or copyright holders", 0.7),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", 0.9),
    ("isc", "the author disclaims all warranties with regard to this software", "author disclaims all warranties", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use", 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary form", 0.9),
    ("bsd-3-clause", "neither the name of [a-z0-9 ]{1,60}? nor the names of its contributors", "neither the name", 0.9),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software", "endorse or promote products", 0.8),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials", 0.9),
    ("bsd-2-clause", "the views and conclusions contained in the software and documentation are those of the authors", "views and conclusions", 0.8),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "software and its documentation", 0.85),
    ("hpnd", "makes no representations about the suitability of this software for any purpose", "suitability of this software", 0.8),
    ("gpl", "this program is free software you can redistribute it and or modify", "free software", 0.9),
    ("gpl", "this program is distributed in the hope that it will be useful", "hope that it will be useful", 0.85),
    ("gpl", "you should have received a copy of the gnu general public license", "you should have received", 0.9),
    ("gpl", "the licenses for most software are designed to take away your freedom", "designed to take away", 0.9),
    ("gpl", "if not write to the free software foundation", "free software foundation", 0.8),
    ("gpl", "either version [23] of the license or at your option any later version", "any later version", 0.8),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", "any later version", 0.85),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", "any later version", 0.85),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft license", 0.95),
    ("gpl-2.0", "the gnu general public license does not permit incorporating your program into proprietary programs", "incorporating your program", 0.85),
    ("lgpl", "this library is free software you can redistribute it and or modify", "free software", 0.9),
    ("lgpl", "this library is distributed in the hope that it will be useful", "hope that it will be useful", 0.85),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "you should have received", 0.9),
    ("lgpl-2.1", "this license the lesser general public license applies to some specially designated software", "lesser general public", 0.95),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "lesser general public", 0.95),
    ("agpl", "you should have received a copy of the gnu affero general public license", "you should have received", 0.9),
    ("agpl-3.0", "the gnu affero general public license is a free copyleft license", "copyleft license", 0.95),
    ("agpl-3.0", "remote network interaction use with the gnu general public license", "remote network interaction", 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "modify this document", 0.95),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts", "invariant sections", 0.95),
    ("gpl-exception-classpath", "linking this library statically or dynamically with other modules is making a combined work", "making a combined work", 0.9),
    ("gpl-exception-gcc", "under the terms of the gcc runtime library exception", "runtime library exception", 0.9),
    ("gpl-exception-linking", "as a special exception the copyright holders (?:of [a-z0-9 ]{1,40}? )?give you permission to link", "as a special exception", 0.9),
    ("gpl-exception-autoconf", "as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script", "configuration script", 0.9),
    ("gpl-exception-bison", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "bison parser skeleton", 0.9),
    ("gpl-exception-font", "as a special exception if you create a document which uses this font", "document which uses this font", 0.9),
    ("linux-syscall-note", "this copyright does not cover user programs that use kernel services by normal system calls", "kernel services", 0.9),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software", "applicable law", 0.85),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance with the license", 0.85),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses", 0.95),
    ("apache-2.0", "see the license for the specific language governing permissions and limitations", "governing permissions", 0.85),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor", "grant of patent license", 0.85),
    ("apache-2.0", "licensed to the apache software foundation asf under one or more contributor license agreements", "contributor license agreements", 0.95),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache software foundation", 0.85),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment", "end user documentation", 0.85),
    ("llvm-exception", "llvm exceptions to the apache 2 0 license", "llvm exceptions", 0.95),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla", "source code form", 0.95),
    ("mpl-2.0", "you can obtain one at https? (?:www )?mozilla org mpl 2 0", "mozilla org", 0.95),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject", 0.95),
    ("mpl-1.1", "the original code is [a-z0-9 ]{1,60}? the initial developer of the original code is", "original code", 0.85),
    ("npl", "the contents of this file are subject to the netscape public license", "netscape public license", 0.95),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development", 0.95),
    ("cpl-1.0", "the accompanying program is provided under the terms of this common public license", "common public license", 0.95),
    ("ipl-1.0", "the accompanying program is provided under the terms of this ibm public license", "ibm public license", 0.95),
    ("epl-1.0", "the accompanying program is provided under the terms of this eclipse public license", "eclipse public license", 0.95),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v|version )? ?2 0", "accompanying materials", 0.95),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 0.9),
    ("edl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse distribution license", "accompanying materials", 0.95),
    ("eupl", "licensed under the eupl", "under the eupl", 0.9),
    ("cecill", "this software is governed by the cecill(?: [bc])? license under french law", "cecill", 0.95),
    ("osl-3.0", "this open software license the license applies to any original work of authorship", "original work of authorship", 0.9),
    ("afl-3.0", "this academic free license the license applies to any original work of authorship", "original work of authorship", 0.95),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", "intent of this document", 0.9),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes the terms", "this license establishes", 0.9),
    ("perl", "this (?:program|library|module) is free software you can redistribute it and or modify it under the same terms as perl itself", "same terms as perl", 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 0.95),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy", 0.95),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 0.9),
    ("public-domain", "this (?:work|software|file|code|document) is (?:in|hereby in) the public domain", "public domain", 0.9),
    ("public-domain", "the authors? disclaims? copyright to this source code", "copyright to this source code", 0.95),
    ("public-domain", "no rights reserved", "no rights reserved", 0.8),
    ("public-domain", "not subject to copyright protection", "copyright protection", 0.6),
    ("cc0-1.0", "to the extent possible under law the (?:person|author)s? [a-z0-9 ]{1,80}? waived all copyright", "waived all copyright", 0.95),
    ("cc0-1.0", "creative commons legal code cc0 1 0 universal", "cc0", 0.95),
    ("cc-by-4.0", "attribution 4 0 international", "4 0 international", 0.85),
    ("cc-by-sa-4.0", "attribution share ?alike 4 0 international", "4 0 international", 0.9),
    ("cc-by-nc-4.0", "attribution non ?commercial 4 0 international", "4 0 international", 0.9),
    ("cc-by-nd-4.0", "attribution no ?derivatives 4 0 international", "4 0 international", 0.9),
    ("cc-by-nc-sa-4.0", "attribution non ?commercial share ?alike 4 0 international", "4 0 international", 0.9),
    ("cc-by-nc-nd-4.0", "attribution non ?commercial no ?derivatives 4 0 international", "4 0 international", 0.9),
    ("cc-by-4.0", "creativecommons org licenses by 4 0", "creativecommons org", 0.95),
    ("cc-by-3.0", "creativecommons org licenses by 3 0", "creativecommons org", 0.95),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0", "creativecommons org", 0.95),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0", "creativecommons org", 0.95),
    ("cc-by-nc", "creativecommons org licenses by nc [1-4]", "creativecommons org", 0.95),
    ("cc-by-nd", "creativecommons org licenses by nd [1-4]", "creativecommons org", 0.95),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4]", "creativecommons org", 0.95),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4]", "creativecommons org", 0.95),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons org", 0.95),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons org", 0.95),
    ("cc", "some rights reserved", "some rights reserved", 0.5),
    ("zlib", "altered source versions must be plainly marked as such", "plainly marked", 0.9),
    ("zlib", "the origin of this software must not be misrepresented", "must not be misrepresented", 0.9),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable", 0.85),
    ("libpng", "the contributing authors and group 42 inc disclaim all warranties", "contributing authors and group 42", 0.95),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization", "hereby granted", 0.9),
    ("boost-1.0", "see accompanying file license 1 0 txt or copy at http www boost org", "boost org", 0.95),
    ("beerware", "you can buy me a beer in return", "buy me a beer", 0.9),
    ("wtfpl", "you just do what the fuck you want to", "do what the fuck", 0.95),
    ("openssl", "this product includes software developed by the openssl project", "openssl project", 0.95),
    ("ssleay", "this product includes cryptographic software written by eric young", "cryptographic software", 0.95),
    ("curl", "copyright c [0-9 ]{4,10} daniel stenberg", "daniel stenberg", 0.8),
    ("json", "the software shall be used for good not evil", "good not evil", 0.95),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "font software", 0.95),
    ("ofl-1.1", "the font software may be modified altered or added to", "font software", 0.9),
    ("ofl-1.1", "with reserved font name", "reserved font name", 0.9),
    ("bitstream-vera", "bitstream vera is a trademark of bitstream inc", "bitstream vera", 0.9),
    ("ubuntu-font-1.0", "ubuntu font licence", "ubuntu font", 0.9),
    ("unicode", "copyright c [0-9 ]{4,10} unicode inc all rights reserved distributed under the terms of use", "unicode inc", 0.95),
    ("unicode", "to deal in the data files or software without restriction", "data files or software", 0.95),
    ("icu", "copyright c [0-9 ]{4,10} international business machines corporation and others", "international business machines", 0.7),
    ("w3c", "by obtaining using and or copying this work you the licensee agree that you have read understood", "by obtaining using", 0.9),
    ("x11", "except as contained in this notice the name of the x consortium shall not be used", "x consortium", 0.95),
    ("xfree86-1.1", "this product includes software developed by the xfree86 project", "xfree86 project", 0.95),
    ("ncsa", "developed by [a-z0-9 ]{1,60}? university of illinois", "university of illinois", 0.8),
    ("python-2.0", "psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby grants", 0.95),
    ("ruby", "ruby is copyrighted free software by yukihiro matsumoto", "yukihiro matsumoto", 0.95),
    ("php-3.01", "this product includes php software freely available from", "includes php software", 0.95),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special", "university of california", 0.7),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and license this software", "hereby grant permission", 0.95),
    ("vim", "vim is charityware", "charityware", 0.95),
    ("info-zip", "for the purposes of this copyright and license info zip is defined as", "info zip", 0.95),
    ("bzip2-1.0.6", "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required", "product documentation would be appreciated", 0.7),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group", 0.95),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license", "license governs use", 0.9),
    ("tex-lppl", "this work may be distributed and or modified under the conditions of the latex project public license", "latex project", 0.95),
    ("eupl", "pursuant to the european union public licence", "european union public", 0.8),
    ("odbl", "this database is made available under the open database license", "open database", 0.95),
    ("odbl", "any rights in individual contents of the database are licensed under", "contents of the database", 0.9),
    ("pddl", "open data commons public domain dedication", "open data commons", 0.95),
    ("odc-by", "open data commons attribution license", "open data commons", 0.95),
    ("ogl-uk-3.0", "contains public sector information licensed under the open government licence", "public sector information", 0.95),
    ("ogl-uk", "you are free to copy publish distribute and transmit the information", "transmit the information", 0.8),
    ("etalab-2.0", "licence ouverte", "licence ouverte", 0.85),
    ("dl-de-by-2.0", "datenlizenz deutschland namensnennung", "datenlizenz", 0.95),
    ("sspl", "making the functionality of the program or modified version available to third parties as a service", "functionality of the program", 0.9),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "non production use", 0.95),
    ("busl-1.1", "effective on the change date", "change date", 0.8),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service", "hosted or managed service", 0.95),
    ("commons-clause", "the license does not grant to you the right to sell the software", "right to sell the software", 0.95),
    ("polyform-noncommercial", "any noncommercial purpose is a permitted purpose", "noncommercial purpose", 0.95),
    ("openrail", "use restrictions set forth in attachment a", "attachment a", 0.7),
    ("llama", "llama (?:2 |3 )?community license agreement", "community license agreement", 0.95),
    ("proprietary", "this software is (?:the )?(?:confidential and )?proprietary (?:information )?(?:of|to)", "proprietary", 0.8),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying", 0.9),
    ("proprietary", "no part of this (?:publication|document|book|work) may be reproduced", "no part of this", 0.8),
    ("proprietary", "may not be reproduced or (?:distributed|transmitted) [a-z0-9 ]{1,40}? without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", "may not be reproduced", 0.8),
    ("proprietary", "end user license agreement", "end user license", 0.7),
    ("proprietary", "all content on this (?:web ?)?site is protected by copyright", "protected by copyright", 0.7),
    ("noncommercial", "for (?:personal and )?non ?commercial use only", "commercial use only", 0.8),
    ("noncommercial", "for (?:academic|research|educational) (?:and research )?(?:use|purposes) only", " only", 0.5),
    ("reprint-permission", "reprinted (?:with|by) permission", "reprinted", 0.6),
    ("reprint-permission", "used (?:with|by) permission", "permission", 0.5),
    ("trademark", "(?:is|are) (?:a )?(?:registered )?trademarks? of", "trademark", 0.4),
    ("warranty-disclaimer", "(?:the |this )?software is provided (?:by [a-z0-9 ]{1,60}? )?as is", "as is", 0.5),
    ("warranty-disclaimer", "without warrant(?:y|ies) of any kind", "without warrant", 0.5),
    ("warranty-disclaimer", "without any warranty", "without any warranty", 0.5),
    ("warranty-disclaimer", "implied warrant(?:y|ies) of merchantability", "merchantability", 0.5),
    ("warranty-disclaimer", "fitness for a particular purpose", "particular purpose", 0.5),
    ("liability-disclaimer", "in no event shall [a-z0-9 ]{1,80}? be liable for any (?:direct|claim|special)", "in no event shall", 0.5),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", 0.6),
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """``label, regex, keywords, priority, confidence`` of all rules in order; every match of a rule holds one
    of its keywords. Within a frame names keep their order, which goes from the specific to the general."""
    found = []
    for frame, around, priority, confidence in FRAMES:
        for label, name, keywords in NAMES:
            if frame == "field" and label in COMMON:
                continue
            whole = around.replace("@ licen[cs]e", "@(?: licen[cs]e)?") if "license" in name else around
            found.append((label, whole.replace("@", name), keywords, priority, confidence))
    return found + [(label, regex, keyword, 1, confidence) for label, regex, keyword, confidence in CLAUSES]


def longest_match() -> int:
    """No match has more words: blanks of a regex match one blank each, and nothing repeats but in {1,n}."""
    return max(1 + r[1].count(" ") + sum(map(int, re.findall(r",(\d+)\}", r[1]))) for r in rules())


_SPAN = "array<struct<start:int,end:int>>"


def _marked(padded: Column, regex: str) -> Column:
    """The text with a mark before the first and after the last word of each match of a regex without groups."""
    return F.regexp_replace(padded, F.lit(f" ({regex})(?= )"), F.lit(" \x01$1\x02"))


def _places(marked: Column) -> Column:
    """First word and end of each match in a marked text that begins with a blank: one pass over its words."""

    def at(words: Column, test, shift: int) -> Column:
        return F.array_compact(F.transform(words, lambda w, i: F.when(test(w), i - shift)))

    def paired(words: Column) -> Column:
        return F.zip_with(
            at(words, lambda w: F.startswith(w, F.lit("\x01")), 1),
            at(words, lambda w: F.endswith(w, F.lit("\x02")), 0),
            lambda a, b: F.struct(a.alias("start"), b.alias("end")),
        )

    return let(F.split(marked, " "), paired)


def _detections(padded: Column) -> Column:
    every = rules()
    keywords = sorted({k for r in every for k in r[2].split("|")})
    number = {k: i for i, k in enumerate(keywords)}

    def found(has: Column) -> Column:
        """Numbers of the rules that match: a regex runs only behind its keyword."""

        def one(i: int) -> Column:
            gate = reduce(lambda a, b: a | b, [F.get(has, F.lit(number[k])) for k in every[i][2].split("|")])
            return F.when(gate & F.rlike(padded, F.lit(f" (?:{every[i][1]})(?= )")), F.lit(i))

        return F.array_compact(F.array(*[one(i) for i in range(len(every))]))

    def spans(n: Column) -> Column:
        marked = F.when(n == 0, _marked(padded, every[0][1]))
        for i in range(1, len(every)):
            marked = marked.when(n == i, _marked(padded, every[i][1]))
        column = lambda k: F.get(F.array(*[F.lit(r[k]) for r in every]), n)
        return F.transform(
            _places(marked),
            lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("minus_end"), column(3).alias("rank"), column(0).alias("label"), column(4).alias("sure")),
        )

    none = F.array().cast("array<struct<start:int,minus_end:int,rank:int,label:string,sure:double>>")
    hits = let(
        F.array(*[F.contains(padded, F.lit(k)) for k in keywords]),
        lambda has: F.when(F.exists(has, lambda x: x), F.flatten(F.transform(found(has), spans))).otherwise(none),
    )

    def survives(all_: Column, reach: Column, d: Column, i: Column) -> Column:
        near = F.slice(all_, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach)
        return ~F.exists(
            near,
            lambda o: (o["start"] <= d["start"])
            & (o["minus_end"] <= d["minus_end"])
            & (
                (o["rank"] < d["rank"])
                | (
                    (o["rank"] == d["rank"])
                    & ((o["start"] < d["start"]) | (o["minus_end"] < d["minus_end"]))
                )
            ),
        )

    longest = longest_match()

    def reach(all_: Column) -> Column:
        """So many neighbours to each side hold all that can contain a detection: beyond them starts are further
        away than the longest match. The least of some powers for which this is so, else all."""

        def beyond(r: Column) -> Column:
            close = F.filter(all_, lambda x, i: F.get(all_, i + r)["start"] <= x["start"] + longest)
            return F.size(close) == 0

        return F.coalesce(F.get(F.filter(F.array(*[F.lit(4**k) for k in range(2, 12)]), beyond), F.lit(0)), F.size(all_))

    return let(
        F.array_sort(F.array_distinct(hits)),
        lambda all_: let(reach(all_), lambda r: F.filter(all_, lambda d, i: survives(all_, r, d, i))),
    )


def scan(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``detections`` (start, end, label, confidence), one row per document."""

    def base(s: Column) -> Column:
        def one(label: str, phrase: str) -> Column:
            at = F.when(F.contains(s, F.lit(f" {phrase} ")), _places(_marked(s, phrase))).otherwise(F.array().cast(_SPAN))
            return F.transform(at, lambda x: F.struct(x["start"].alias("start"), F.lit(label).alias("label")))

        return F.flatten(F.array(*[one(label, phrase) for label, phrase in PHRASES.items()]))

    def read(words: Column) -> Column:
        padded = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        seen = let(padded, lambda s: F.struct(base(s).alias("base"), _detections(s).alias("own")))
        return F.struct(F.size(words).cast("long").alias("n_words"), seen.alias("x"))

    seen = documents.select(F.col(doc_id).alias("doc_id"), let(alnum_words(F.col(text)), read).alias("r"))
    seen = seen.select(
        "doc_id",
        "r.n_words",
        F.col("r.x.base").alias("base"),
        F.transform(
            F.col("r.x.own"),
            lambda d: F.struct(d["start"].alias("start"), (-d["minus_end"]).alias("end"), d["label"].alias("label"), d["sure"].alias("confidence")),
        ).alias("detections"),
    )
    base_labels = F.array_distinct(F.transform("base", lambda b: b["label"]))
    own_labels = F.array_distinct(F.transform("detections", lambda d: d["label"]))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    return seen.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, own_labels)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        "detections",
    )
