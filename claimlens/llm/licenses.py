"""License scan with ordered signature rules, in DataFrame functions only.

A rule is a regular expression over a paragraph's words with a keyword that every match contains, a label and a priority.
A paragraph ends at a blank line, so a match may run over any number of wrapped lines. Texts without any keyword are
passed over; in the others only paragraphs with a keyword are read, and on them only rules whose keyword occurs. Of the
matches of a paragraph, one inside the interval of a longer match is dropped, and of equal intervals the one with the
highest priority stays; matches that merely overlap both stay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.text import let, running_sums

#: Everything that is not a word byte of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` before A-Z are lower-cased.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Between two paragraphs: one or more lines of white space only.
_BREAK = r"\n[\x09\x0B-\x0D\x20]*\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NO_MATCH = "cast(array() as array<struct<start:int,back:int,rank:int,label:string,words:int>>)"

#: Fixed phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_V = r"(?: version| v)?"
#: Label, pattern of the name in words, keyword that the name always contains.
NAMES = [
    ("apache-2.0", rf"apache(?: software)?(?: licen[sc]e)?{_V} ?2(?: 0)?", "apache"),
    ("apache-1.1", rf"apache(?: software)?(?: licen[sc]e)?{_V} 1 1", "apache"),
    ("apache", r"apache(?: software)? licen[sc]e", "apache"),
    ("mit", r"(?:expat )?mit(?: x11)? licen[sc]e", "mit "),
    ("mit-0", r"mit no attribution(?: licen[sc]e)?", "no attribution"),
    ("x11", r"x11 licen[sc]e", "x11"),
    ("isc", r"isc licen[sc]e", "isc licen"),
    ("bsd", r"bsd(?: style)? licen[sc]e", "bsd"),
    ("0bsd", r"(?:zero clause bsd|0bsd)(?: licen[sc]e)?", "bsd"),
    ("bsd-2-clause", r"(?:simplified|freebsd|2 clause|two clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?", "bsd"),
    ("bsd-3-clause", r"(?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?", "bsd"),
    ("bsd-4-clause", r"(?:original|4 clause|four clause) bsd(?: licen[sc]e)?|bsd 4 clause(?: licen[sc]e)?", "bsd"),
    ("gpl", r"(?:gnu )?general public licen[sc]e", "general public"),
    ("gpl-1.0", rf"(?:gnu )?(?:gpl|general public licen[sc]e){_V} ?1(?: 0)?", "g"),
    ("gpl-2.0", rf"(?:gnu )?(?:gpl|general public licen[sc]e){_V} ?2(?: 0)?", "g"),
    ("gpl-3.0", rf"(?:gnu )?(?:gpl|general public licen[sc]e){_V} ?3(?: 0)?", "g"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", "general public"),
    ("lgpl-2.0", rf"(?:gnu )?(?:lgpl|library general public licen[sc]e){_V} ?2(?: 0)?", "l"),
    ("lgpl-2.1", rf"(?:gnu )?(?:lgpl|lesser general public licen[sc]e){_V} ?2 1", "l"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lgpl|lesser general public licen[sc]e){_V} ?3(?: 0)?", "l"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e", "affero"),
    ("agpl-3.0", rf"(?:gnu )?(?:agpl|affero general public licen[sc]e){_V} ?3(?: 0)?", "a"),
    ("gfdl", rf"(?:gnu )?free documentation licen[sc]e(?:{_V} 1 [123])?", "free documentation"),
    ("mpl-1.1", rf"mozilla public licen[sc]e{_V} 1 1|mpl 1 1", "m"),
    ("mpl-2.0", rf"mozilla public licen[sc]e{_V} 2 0|mpl 2 0", "m"),
    ("mpl", r"mozilla public licen[sc]e", "mozilla"),
    ("epl-1.0", rf"eclipse public licen[sc]e{_V} 1(?: 0)?|epl 1 0", "e"),
    ("epl-2.0", rf"eclipse public licen[sc]e{_V} 2(?: 0)?|epl 2 0", "e"),
    ("edl-1.0", rf"eclipse distribution licen[sc]e(?:{_V} 1 0)?", "eclipse"),
    ("cddl-1.0", rf"common development and distribution licen[sc]e(?:{_V} 1 0)?|cddl(?: 1 0)?", "d"),
    ("cpl-1.0", rf"common public licen[sc]e(?:{_V} 1 0)?", "common public"),
    ("eupl-1.2", rf"european union public licen[sc]e(?:{_V} 1 2)?|eupl(?: 1 2)?", "e"),
    ("cecill-2.1", r"cecill(?: 2 1)?(?: free software licen[sc]e)?", "cecill"),
    ("osl-3.0", rf"open software licen[sc]e(?:{_V} 3 0)?", "open software"),
    ("afl-3.0", rf"academic free licen[sc]e(?:{_V} 3 0)?", "academic free"),
    ("artistic-1.0", rf"artistic licen[sc]e{_V} 1 0", "artistic"),
    ("artistic-2.0", rf"artistic licen[sc]e{_V} 2 0", "artistic"),
    ("artistic", r"artistic licen[sc]e", "artistic"),
    ("bsl-1.0", rf"boost software licen[sc]e(?:{_V} 1 0)?", "boost"),
    ("busl-1.1", rf"business source licen[sc]e(?:{_V} 1 1)?", "business source"),
    ("elastic-2.0", rf"elastic licen[sc]e(?:{_V} 2(?: 0)?)?", "elastic"),
    ("sspl-1.0", rf"server side public licen[sc]e(?:{_V} 1(?: 0)?)?", "server side"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("libpng", r"libpng licen[sc]e", "libpng"),
    ("unlicense", r"the unlicen[sc]e", "unlicen"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", "w"),
    ("psf-2.0", r"(?:python software foundation|psf) licen[sc]e", "licen"),
    ("php-3.01", rf"php licen[sc]e(?:{_V} 3 01)?", "php"),
    ("ruby", r"ruby licen[sc]e", "ruby"),
    ("vim", r"vim licen[sc]e", "vim licen"),
    ("openssl", r"openssl licen[sc]e", "openssl"),
    ("ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa licen[sc]e", "ncsa"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("ofl-1.1", rf"(?:sil )?open font licen[sc]e(?:{_V} 1 1)?", "open font"),
    ("odbl-1.0", rf"open (?:data commons open )?database licen[sc]e(?:{_V} 1 0)?|odbl", "o"),
    ("odc-by-1.0", r"open data commons attribution licen[sc]e|odc by", "od"),
    ("pddl-1.0", r"public domain dedication and licen[sc]e|pddl", "p"),
    ("ogl-uk-3.0", rf"open government licen[sc]e(?:{_V} 3 0)?", "open government"),
    ("ms-pl", r"microsoft public licen[sc]e|ms pl", "m"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", "microsoft"),
    ("intel", r"intel open source licen[sc]e", "intel"),
    ("upl-1.0", rf"universal permissive licen[sc]e(?:{_V} 1 0)?", "universal permissive"),
    ("mulan-psl-2.0", rf"mulan (?:permissive software licen[sc]e|psl)(?:{_V} ?2)?", "mulan"),
    ("llama", r"llama [0-9](?: [0-9])? community licen[sc]e", "community licen"),
    ("openrail", r"(?:big ?science |creativeml )?open ?rail(?: m)?(?: licen[sc]e)?", "rail"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "c"),
    ("cc-by", r"cc by(?: [1234] [05])?|creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?", "c"),
    ("cc-by-sa", r"cc by sa(?: [1234] [05])?|creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?", "c"),
    ("cc-by-nc", r"cc by nc(?: [1234] [05])?|creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?", "c"),
    ("cc-by-nd", r"cc by nd(?: [1234] [05])?|creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)?", "c"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1234] [05])?|creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?", "c"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1234] [05])?|creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)?", "c"),
]
#: Rules built for every name: pattern around it, keyword added to the gate, priority.
FORMS = [
    ("{name}", "", 1),
    (r"(?:licen[sc]ed|released|distributed|available|provided|published|covered|redistributed|used) (?:under|subject to|according to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})(?: licen[sc]e)?(?: or (?:at your option )?(?:any )?later(?: version)?)?", "", 3),
    (r"see (?:the )?(?:{name})(?: licen[sc]e)? for (?:more )?details", "details", 3),
]
#: Label, pattern, keyword, priority of rules without a license name.
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?", "hereby granted", 4),
    ("isc", "permission to use copy modify and or distribute this software for any purpose(?: with or without fee)?", "permission to use", 4),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 4),
    ("bsd-3-clause", "neither the name of .{1,80}? may be used to endorse or promote products", "neither the name", 4),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials", 4),
    ("gpl", "this program is free software you can redistribute it and or modify it", "free software", 4),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "free software", 4),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose", "implied warranty", 2),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license(?: v ?2 0)?", "source code form", 4),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors", "in no event", 4),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted", 4),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 4),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", 2),
    ("public-domain", "(?:is|are) in the public domain", "public domain", 1),
    ("cc0", "no copyright reserved|waived all copyright and related", "copyright", 3),
    ("cc", "this work is licensed under a creative commons", "creative commons", 2),
    ("cc-by", "creativecommons org licenses by [1234] [05]", "creativecommons", 3),
    ("cc-by-sa", "creativecommons org licenses by sa [1234] [05]", "creativecommons", 4),
    ("cc-by-nc", "creativecommons org licenses by nc [1234] [05]", "creativecommons", 4),
    ("cc0", "creativecommons org publicdomain zero 1 0", "creativecommons", 4),
    ("apache-2.0", "www apache org licenses license 2 0", "apache", 4),
    ("gpl", "www gnu org licenses(?: gpl)?", "gnu org", 2),
    ("mit", "opensource org licenses mit", "opensource", 3),
    ("reserved", "all rights reserved", "rights reserved", 1),
    ("reserved", "no part of this (?:publication|book|work|document) may be reproduced", "no part of this", 2),
    ("copyright", "copyright(?: c)?(?: (?:19|20)[0-9][0-9](?![^ ]))++", "copyright", 1),  # possessive: no stack per year
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary", 2),
    ("proprietary", "unauthorized (?:copying|use|distribution|reproduction) (?:of this .{1,40}? )?is (?:strictly )?prohibited", "unauthorized", 2),
    ("proprietary", "end user licen[sc]e agreement", "end user", 2),
    ("noncommercial", "for (?:non ?commercial|personal|educational) use only", "use only", 2),
    ("research-only", "for (?:academic|research) (?:and educational )?(?:use|purposes) only", "only", 2),
    ("attribution", "with proper attribution|provided that (?:the )?(?:source|author) is (?:credited|acknowledged)", "a", 1),
    # grants
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "without restriction", 4),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", "permission notice", 4),
    ("mit-style", "permission is granted to (?:anyone|any person) to use this software for any purpose", "permission is granted", 3),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", "permission notice", 4),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use", 4),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "required by applicable law", 4),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance", 4),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license", "hereby grants", 4),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledg?ment", "end user documentation", 4),
    ("gpl", "either version [123](?: 0)? of the license or at your option any later version", "any later version", 3),
    ("gpl-2.0-only", "gpl(?: v| version)? ?2(?: 0)? only", "only", 4),
    ("gpl-3.0-only", "gpl(?: v| version)? ?3(?: 0)? only", "only", 4),
    ("gpl-2.0-or-later", "gpl(?: v| version)? ?2(?: 0)?(?: or (?:any )?later| plus)", "gpl", 4),
    ("gpl-3.0-or-later", "gpl(?: v| version)? ?3(?: 0)?(?: or (?:any )?later| plus)", "gpl", 4),
    ("gpl", "you should have received a copy of the gnu general public license", "should have received", 3),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public license", "should have received", 4),
    ("agpl", "you should have received a copy of the gnu affero general public license", "should have received", 4),
    ("gpl-exception", "as a special exception .{1,120}? (?:link|combine|linking)", "special exception", 3),
    ("gpl-classpath-exception", "classpath exception|linking this library statically or dynamically with other modules", "l", 4),
    ("gpl-font-exception", "if you create a document which uses this font", "uses this font", 4),
    ("llvm-exception", "(?:apache(?: licen[sc]e)?(?: v)? ?2(?: 0)? )?with llvm exceptions?", "llvm exception", 4),
    ("agpl", "interacting with it remotely through a computer network", "remotely through", 4),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source", 3),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions in binary", 3),
    ("bsd", "this software is provided by .{1,80}? as is and any express or implied warranties", "implied warranties", 3),
    ("bsd-4-clause", "this product includes software developed by", "software developed by", 3),
    ("bsd-patent", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants", "hereby grants", 4),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license", "contents of this file", 4),
    ("npl", "the contents of this file are subject to the netscape public license", "contents of this file", 4),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", "contents of this file", 4),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", 4),
    ("cpl-1.0", "this program and the accompanying materials are made available under the terms of the common public license", "accompanying materials", 4),
    ("edl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse distribution license", "accompanying materials", 4),
    ("zlib", "altered source versions must be plainly marked as such", "altered source versions", 4),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", 4),
    ("libpng", "this copy of the libpng notices is provided for your convenience", "libpng", 4),
    ("ijg", "this software is based in part on the work of the independent jpeg group", "independent jpeg group", 4),
    ("openssl", "this product includes software developed by the openssl project", "openssl project", 4),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided", "permission to use", 4),
    ("ofl-1.1", "this font software is licensed under the sil open font license(?: version 1 1)?", "font software", 4),
    ("ofl-1.1", "reserved font name", "reserved font name", 2),
    ("bitstream-vera", "fonts generated using vera", "generated using vera", 4),
    ("bitstream-vera", "bitstream vera fonts copyright", "bitstream vera", 4),
    ("wtfpl", "do what the f ?(?:uck|ck)? you want to(?: public licen[sc]e)?", "you want to", 4),
    ("beerware", "(?:the )?beer ?ware licen[sc]e", "licen", 4),
    ("beerware", "you can buy me a beer in return", "buy me a beer", 4),
    ("postcardware", "send (?:me|us) a postcard", "postcard", 2),
    ("json", "the software shall be used for good not evil", "good not evil", 4),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 4),
    ("cc0", "to the extent possible under law .{1,80}? has waived all copyright", "extent possible under law", 4),
    ("cc0", "dedicate any and all copyright interest in the software to the public domain", "copyright interest", 4),
    ("public-domain", "this (?:work|file|software|code|text) (?:is|has been) (?:hereby )?(?:placed|released) (?:in|into) the public domain", "public domain", 3),
    ("public-domain", "public domain (?:work|mark|dedication|notice)", "public domain", 2),
    ("public-domain", "no known copyright restrictions", "known copyright restrictions", 3),
    ("public-domain", "a work of the united states government", "united states government", 3),
    # creative works and data
    ("cc-by", "you are free to share copy and redistribute the material", "copy and redistribute", 3),
    ("cc-by", "you must give appropriate credit provide a link to the license", "appropriate credit", 3),
    ("cc-by-sa", "you must distribute your contributions under the same license as the original", "same license as the original", 4),
    ("cc-by-sa", "share ?alike", "alike", 1),
    ("cc-by-nc", "you may not use the material for commercial purposes", "commercial purposes", 4),
    ("cc-by-nd", "you may not distribute the modified material", "modified material", 4),
    ("cc-by-nd", "no ?derivatives", "derivatives", 1),
    ("cc-by-nc", "attribution non ?commercial", "attribution", 2),
    ("cc-by-sa", "attribution share ?alike", "attribution", 2),
    ("cc-by-nd", "attribution no ?derivs", "attribution", 2),
    ("cc", "some rights reserved", "rights reserved", 2),
    ("odbl-1.0", "any rights in individual contents of the database are licensed under the database contents license", "database contents", 4),
    ("odbl-1.0", "made available under the open database licen[sc]e", "open database", 4),
    ("ogl-uk", "contains public sector information licensed under the open government licen[sc]e", "public sector information", 4),
    ("ogl-uk", "open government licen[sc]e(?: v ?[123](?: 0)?)?", "open government", 3),
    ("etalab-2.0", "licence ouverte(?: open licen[sc]e)?(?: v(?:ersion)? 2 0)?", "licence ouverte", 3),
    ("dl-de-by-2.0", "datenlizenz deutschland(?: namensnennung)?(?: version 2 0)?", "datenlizenz", 3),
    ("cdla", "community data license agreement(?: permissive| sharing)?", "community data", 3),
    ("free-art", "free art licen[sc]e|licence art libre", "art", 3),
    ("gutenberg", "project gutenberg license|you may copy it give it away or re use it under the terms", "g", 3),
    ("fair-use", "fair use (?:notice|doctrine)|constitutes a fair use", "fair use", 2),
    # restricted and commercial
    ("reserved", "tous droits r[ée]serv[ée]s", "droits", 2),
    ("reserved", "todos los derechos reservados", "derechos reservados", 2),
    ("reserved", "alle rechte vorbehalten", "rechte vorbehalten", 2),
    ("reserved", "reproduction (?:in whole or in part )?(?:without (?:written )?permission )?is (?:strictly )?(?:prohibited|forbidden)", "reproduction", 2),
    ("reserved", "without the (?:prior )?(?:express )?(?:written )?(?:permission|consent) of the (?:publisher|author|copyright (?:holder|owner))", "of the", 2),
    ("reserved", "used (?:by|with) (?:kind )?permission", "permission", 1),
    ("reserved", "reprinted (?:by|with) permission", "reprinted", 2),
    ("proprietary", "this software is the (?:confidential and )?proprietary (?:information|property) of", "proprietary", 3),
    ("proprietary", "licensed (?:materials|material) property of", "property of", 2),
    ("proprietary", "trade secrets? (?:and confidential|of)", "trade secret", 2),
    ("proprietary", "for internal use only", "internal use", 2),
    ("proprietary", "not for (?:re ?)?distribution", "not for", 1),
    ("proprietary", "reverse engineer(?:ing)? decompil(?:e|ing|ation) or disassembl(?:e|ing|y)", "reverse engineer", 2),
    ("proprietary", "you may not (?:copy modify|rent lease|sell sublicense|redistribute or sell)", "you may not", 2),
    ("shareware", "this (?:program|software) is shareware|shareware (?:version|registration)", "shareware", 2),
    ("freeware", "this (?:program|software) is freeware|freeware licen[sc]e", "freeware", 2),
    ("evaluation", "for evaluation purposes only|evaluation licen[sc]e", "evaluation", 2),
    ("noncommercial", "not (?:be used )?for commercial (?:use|purposes)", "commercial", 2),
    ("noncommercial", "commercial use (?:is )?(?:not permitted|prohibited|requires)", "commercial use", 2),
    ("noncommercial", "polyform (?:noncommercial|strict|small business|shield)(?: licen[sc]e)?(?: 1 0 0)?", "polyform", 3),
    ("busl-1.1", "business source licen[sc]e(?: 1 1)?", "business source", 3),
    ("sspl-1.0", "server side public licen[sc]e(?: v(?:ersion)? ?1)?", "server side public", 3),
    ("elastic-2.0", "elastic licen[sc]e(?: v(?:ersion)? ?| )2(?: 0)?", "elastic", 3),
    ("commons-clause", "commons clause(?: licen[sc]e condition)?", "commons clause", 3),
    ("confluent", "confluent community licen[sc]e", "confluent", 3),
    ("hippocratic", "hippocratic licen[sc]e", "hippocratic", 3),
    # models and code of service
    ("openrail", "use based restrictions", "use based restrictions", 2),
    ("openrail", "creativeml open ?rail(?: m)?", "creativeml", 4),
    ("llama", "llama [234](?: [0-9])? community license(?: agreement)?", "llama", 4),
    ("gemma", "gemma terms of use", "gemma", 3),
    ("research-only", "non ?commercial research (?:use|purposes)(?: only)?", "research", 3),
    ("research-only", "available for research (?:use|purposes)", "available for research", 2),
    ("terms-of-service", "by (?:using|accessing) this (?:site|website|service) you agree to", "you agree to", 2),
    ("terms-of-service", "terms (?:of (?:use|service)|and conditions) apply", "apply", 1),
]
#: A text or a paragraph is read on only if it holds one of these; each match of each rule does.
KEYWORDS = ["licen", "cc by", "cc0", "rights reserved", "copyright", "public domain", "creative commons", "creativecommons", "hereby granted", "permission to use",
            "redistribution", "endorse or promote", "advertising materials", "free software", "warranty", "unencumbered", "apache", "gpl", "gnu org", "opensource", "bsd",
            "no part of this", "proprietary", "unauthorized", "use only", "purposes only", "attribution", "is credited", "is acknowledged", "wtfpl", "mpl ", "epl ",
            "cddl", "eupl", "odbl", "odc by", "pddl", "ms pl", "cecill", "mulan", "rail", "spdx",
            "without restriction", "permission", "applicable law", "hereby grants", "acknowledg", "later version", "should have received", "special exception", "classpath", "dynamically with",
            "uses this font", "llvm", "remotely through", "contents of this file", "accompanying materials", "altered source", "misrepresented", "libpng", "jpeg group", "software developed by",
            "font software", "reserved font", "bitstream vera", "using vera", "you want to", "buy me a beer", "postcard", "good not evil", "anyone is free", "waived all", "united states government", "copy and redistribute",
            "appropriate credit", "alike", "commercial", "modified material", "derivatives", "database", "public sector", "datenlizenz", "community data", "art libre", "gutenberg",
            "under the terms", "fair use", "droits", "derechos", "rechte", "reproduction", "consent of the", "reprinted", "property of", "trade secret", "internal use", "not for", "distribution",
            "reverse engineer", "you may not", "shareware", "freeware", "evaluation", "polyform", "business source", "commons clause", "creativeml", "gemma", "based restrictions", "research",
            "you agree to", "terms of", "conditions apply"]


def rules() -> list[dict]:
    """All rules in order: one per name and form, SPDX tags, then the license texts."""
    out = []
    for label, name, keyword in NAMES:
        for form, more, priority in FORMS:
            out.append({"label": label, "pattern": form.replace("{name}", name), "keyword": more or keyword, "priority": priority})
        tag = label.replace(".", " ").replace("-", " ")
        out.append({"label": label, "pattern": f"spdx licen[sc]e identifier {tag}(?: only| or later)?", "keyword": "spdx", "priority": 5})
    out += [{"label": label, "pattern": pattern, "keyword": keyword, "priority": priority} for label, pattern, keyword, priority in TEXTS]
    return [r | {"id": i, "pattern": rf"(?<![^ ])(?:{r['pattern']})(?![^ ])"} for i, r in enumerate(out)]


def plain(text: Column) -> Column:
    """The words of a text with single blanks between, letters as they are."""
    return F.trim(F.regexp_replace(text, _GAP, " "))


def blanks(words: Column) -> Column:
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))


def _holds_any(lowered: Column, keywords: list[str]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(lowered, F.lit(k))
    return found


def _matches(part: Column, rule: Column) -> Column:
    """(start, -end, -priority, label, words) of every match of one rule in a paragraph of words.

    Starts come from running sums of the matches' and the gaps' lengths, so many matches cost little more than few.
    """
    def placed(x):
        ends = running_sums(F.zip_with(x["hits"], x["gaps"], lambda h, g: F.length(h) + F.length(g)))

        def interval(hit: Column, end: Column) -> Column:
            return F.struct((end - F.length(hit)).alias("start"), (-end).alias("back"), (-rule["priority"]).alias("rank"), rule["label"].alias("label"), (blanks(hit) + 1).alias("words"))

        return F.zip_with(x["hits"], ends, interval)

    hits = F.regexp_extract_all(part, rule["pattern"], F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.struct(h.alias("hits"), F.slice(F.split(part, rule["pattern"], -1), F.lit(1), F.size(h)).alias("gaps")), placed)))


def _kept(matches: Column) -> Column:
    """Labels and number of words of the matches that no earlier, longer or preferred one contains."""
    empty = F.expr("named_struct('reach', -1, 'words', 0L, 'labels', cast(array() as array<string>))")

    def step(acc: Column, m: Column) -> Column:
        end = -m["back"]
        more = F.struct(end.alias("reach"), (acc["words"] + m["words"]).cast("long").alias("words"), F.array_union(acc["labels"], F.array(m["label"])).alias("labels"))
        return F.when(end <= acc["reach"], acc).otherwise(more)

    return F.aggregate(F.sort_array(matches), empty, step)


def scan(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score; columns of those names are replaced.

    A null text is empty: no words, no labels (empty strings), score 0. ``score`` is the share of the text's words that
    lie in kept matches, 1 at most. Repeated rows get the same result. Texts of any length, and of any number of matches in a
    paragraph, are read whole; the time grows with n log n.
    """
    table = F.from_json(F.lit(json.dumps(rules())), "array<struct<id:int,label:string,pattern:string,keyword:string,priority:int>>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    out = docs.select(*[f"`{c}`" for c in kept], F.inline(F.array(F.struct(text.alias("_text"), plain(text).alias("_words")))))
    lowered = F.lower("_words")  # more than A-Z, but only to decide what is read
    words = F.col("_words")
    out = out.withColumn("_read", _holds_any(lowered, KEYWORDS)).withColumn("_near", _holds_any(lowered, list(BASE)))
    places, first, last, names = [], [], [], []
    for phrase, label in BASE.items():
        rx = rf"(?i)(?<![^ ]){phrase}(?![^ ])"
        n = F.when(F.col("_near"), F.regexp_count(words, F.lit(rx))).otherwise(0)
        places.append(n.cast("long"))
        # words before the first and before the last place
        first.append(F.when(n > 0, blanks(F.substring(words, F.lit(1), F.regexp_instr(words, F.lit(rx)) - 1))))
        last.append(F.when(n > 0, blanks(F.regexp_extract(words, rf"(?is)^(.*)(?<![^ ]){phrase}(?![^ ])", 1))))
        names.append(F.when(n > 0, F.lit(label)))
    part = lambda x: F.translate(plain(x), _UPPER, _LOWER)
    parts = F.filter(F.transform(F.split("_text", _BREAK), part), lambda x: _holds_any(x, KEYWORDS))
    per_part = F.transform(parts, lambda x: _kept(F.flatten(F.transform(F.filter(table, lambda r: F.contains(x, r["keyword"])), lambda r: F.coalesce(_matches(x, r), F.expr(_NO_MATCH))))))
    none = F.expr("cast(array() as array<struct<reach:int,words:bigint,labels:array<string>>>)")
    n_words = F.when(words == "", F.lit(0)).otherwise(blanks(words) + 1).cast("long")
    # one row each, so that later columns do not repeat the scan
    out = out.select(*[f"`{c}`" for c in kept], F.inline(F.array(F.struct(
        n_words.alias("n_words"), sum(places[1:], places[0]).alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_compact(F.array(*names)).alias("_base"), F.when(F.col("_read"), per_part).otherwise(none).alias("_found")))))
    found = F.flatten(F.transform("_found", lambda m: m["labels"]))
    covered = F.aggregate("_found", F.lit(0).cast("long"), lambda a, m: a + m["words"])
    return out.select(
        *[f"`{c}`" for c in kept], "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", found)), ",").alias("labels"), F.least(F.lit(1.0), F.coalesce(covered / F.nullif(F.col("n_words"), F.lit(0)), F.lit(0.0))).alias("score"))
