"""License scans by ordered signature rules.

A text is reduced to its words in lower case with single spaces. Rules are regular expressions over that,
in an order of priority: signatures written by hand of license texts, notices and headers, and the names, addresses,
versions and identifiers of license families. Each is gated by words that must occur at all before it runs; one pass
of an automaton finds those of all rules. Where detections overlap, one whose interval lies within that of a detection of a higher tier, or of the same and longer, is
suppressed, so that "GNU Lesser General Public License v2.1" is one license and not four.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.common import map_texts

# The phrases of the base and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licenses as (label, regular expressions of names, words of addresses, versions). Names and
# addresses are over lower-case words; a version is appended to the label and looked for as words.
FAMILIES = (
    ("agpl", ("gnu affero (?:general )?public licen[sc]e", "affero general public licen[sc]e", "agpl"), ("gnu org licenses agpl",), ("1.0", "3.0")),
    ("lgpl", ("gnu (?:lesser|library) (?:general )?public licen[sc]e", "(?:lesser|library) general public licen[sc]e", "lgpl"), ("gnu org licenses lgpl", "gnu org copyleft lesser"), ("2.0", "2.1", "3.0")),
    ("gfdl", ("gnu free documentation licen[sc]e", "free documentation licen[sc]e", "gfdl"), ("gnu org licenses fdl", "gnu org copyleft fdl"), ("1.1", "1.2", "1.3")),
    ("gpl", ("gnu general public licen[sc]e", "general public licen[sc]e", "gnu gpl", "gpl"), ("gnu org licenses gpl", "gnu org copyleft gpl"), ("1.0", "2.0", "3.0")),
    ("apache", ("apache (?:software )?licen[sc]e", "asl"), ("apache org licenses license",), ("1.0", "1.1", "2.0")),
    ("cc-by-nc-nd", ("creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?", "cc by nc nd"), ("creativecommons org licenses by nc nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", ("creative commons attribution non ?commercial share ?alike", "cc by nc sa"), ("creativecommons org licenses by nc sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution non ?commercial", "cc by nc"), ("creativecommons org licenses by nc",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution no ?deriv(?:ative|atives|s)(?: works)?", "cc by nd"), ("creativecommons org licenses by nd",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution share ?alike", "cc by sa"), ("creativecommons org licenses by sa",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by", ("creative commons attribution", "cc by"), ("creativecommons org licenses by",), ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc0", ("cc0", "cc zero", "creative commons zero"), ("creativecommons org publicdomain zero",), ("1.0",)),
    ("pddl", ("public domain dedication and licen[sc]e", "pddl"), ("opendatacommons org licenses pddl",), ("1.0",)),
    ("odbl", ("open database licen[sc]e", "odbl"), ("opendatacommons org licenses odbl",), ("1.0",)),
    ("odc-by", ("open data commons attribution licen[sc]e", "odc by"), ("opendatacommons org licenses by",), ("1.0",)),
    ("cdla-permissive", ("community data licen[sc]e agreement permissive", "cdla permissive"), ("cdla dev permissive",), ("1.0", "2.0")),
    ("mpl", ("mozilla public licen[sc]e", "mpl"), ("mozilla org mpl", "mozilla org en us mpl"), ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public licen[sc]e", "epl"), ("eclipse org legal epl",), ("1.0", "2.0")),
    ("edl", ("eclipse distribution licen[sc]e",), ("eclipse org org documents edl",), ("1.0",)),
    ("cpl", ("common public licen[sc]e",), ("ibm com developerworks library os cpl",), ("1.0",)),
    ("cddl", ("common development and distribution licen[sc]e", "cddl"), ("opensource org licenses cddl",), ("1.0", "1.1")),
    ("eupl", ("european union public licen[sc]e", "eupl"), ("joinup ec europa eu collection eupl",), ("1.0", "1.1", "1.2")),
    ("osl", ("open software licen[sc]e", "osl"), ("opensource org licenses osl",), ("1.0", "2.0", "2.1", "3.0")),
    ("afl", ("academic free licen[sc]e",), ("opensource org licenses afl",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", ("artistic licen[sc]e",), ("perlfoundation org artistic license", "opensource org licenses artistic license"), ("1.0", "2.0")),
    ("bsl", ("boost software licen[sc]e",), ("boost org license",), ("1.0",)),
    ("busl", ("business source licen[sc]e",), ("mariadb com bsl",), ("1.1",)),
    ("sspl", ("server side public licen[sc]e", "sspl"), ("mongodb com licensing server side public license",), ("1",)),
    ("elastic", ("elastic licen[sc]e",), ("elastic co licensing elastic license",), ("2.0",)),
    ("bsd-4-clause", ("bsd (?:4|four) clause", "(?:4|four) clause bsd", "original bsd"), ("opensource org licenses bsd 4 clause",), ()),
    ("bsd-3-clause", ("bsd (?:3|three) clause", "(?:3|three) clause bsd", "(?:new|modified|revised) bsd"), ("opensource org licenses bsd 3 clause",), ()),
    ("bsd-2-clause", ("bsd (?:2|two) clause", "(?:2|two) clause bsd", "(?:simplified|freebsd) bsd"), ("opensource org licenses bsd 2 clause",), ()),
    ("0bsd", ("0bsd", "(?:zero|0) clause bsd"), ("opensource org licenses 0bsd",), ()),
    ("bsd", ("bsd licen[sc]e", "bsd style licen[sc]e"), ("opensource org licenses bsd",), ()),
    ("mit-0", ("mit no attribution", "mit 0"), ("opensource org licenses mit 0",), ()),
    ("mit", ("mit licen[sc]e", "expat licen[sc]e", "mit expat"), ("opensource org licenses mit", "mit license org"), ()),
    ("x11", ("x11 licen[sc]e", "mit x11"), ("x org releases x11r7 6 doc license",), ()),
    ("isc", ("isc licen[sc]e",), ("opensource org licenses isc",), ()),
    ("ncsa", ("university of illinois ncsa open source licen[sc]e", "ncsa open source licen[sc]e"), ("opensource org licenses ncsa",), ()),
    ("zlib", ("zlib licen[sc]e", "zlib libpng licen[sc]e"), ("zlib net zlib license", "opensource org licenses zlib"), ()),
    ("libpng", ("libpng licen[sc]e", "png reference library licen[sc]e"), ("libpng org pub png src libpng license",), ("2.0",)),
    ("openssl", ("openssl licen[sc]e", "dual openssl ssleay licen[sc]e"), ("openssl org source license",), ()),
    ("python", ("python software foundation licen[sc]e", "psf licen[sc]e"), ("python org psf license", "docs python org 3 license"), ("2.0",)),
    ("php", ("php licen[sc]e",), ("php net license",), ("3.0", "3.01")),
    ("ruby", ("ruby licen[sc]e",), ("ruby lang org en about license",), ()),
    ("postgresql", ("postgresql licen[sc]e",), ("postgresql org about licence",), ()),
    ("curl", ("curl licen[sc]e",), ("curl se docs copyright",), ()),
    ("unlicense", ("unlicense",), ("unlicense org",), ()),
    ("wtfpl", ("do what the fuck you want to public licen[sc]e", "wtfpl"), ("wtfpl net",), ("2",)),
    ("ms-pl", ("microsoft public licen[sc]e", "ms pl"), ("opensource org licenses ms pl",), ()),
    ("ms-rl", ("microsoft reciprocal licen[sc]e", "ms rl"), ("opensource org licenses ms rl",), ()),
    ("ofl", ("sil open font licen[sc]e", "open font licen[sc]e"), ("scripts sil org ofl", "openfontlicense org"), ("1.0", "1.1")),
    ("ecl", ("educational community licen[sc]e",), ("opensource org licenses ecl",), ("1.0", "2.0")),
    ("lppl", ("latex project public licen[sc]e", "lppl"), ("latex project org lppl",), ("1.0", "1.2", "1.3")),
    ("vim", ("vim licen[sc]e",), ("vimhelp org uganda txt",), ()),
    ("w3c", ("w3c software (?:notice and )?licen[sc]e",), ("w3 org consortium legal copyright software",), ()),
    ("openrail", ("open rail(?: m)? licen[sc]e", "openrail", "creativeml open rail m"), ("huggingface co spaces compvis stable diffusion license",), ()),
    ("llama", ("llama (?:[0-9] )*community licen[sc]e",), ("ai meta com llama license", "llama com license"), ()),
)

# Signatures of license texts, notices and headers, in the order of priority: the license and the words that
# tell it. What a rule must find before it runs is the longest run of plain characters of its own expression.
SIGNATURES = (
    # permissive licenses: grants, conditions and disclaimers of their texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of (?:this software|the software)"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("x11", "except as contained in this notice the name of .{1,80} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "the author disclaims all warranties with regard to this software"),
    ("isc", "isc disclaims all warranties with regard to this software"),
    ("isc", "action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd", "that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment"),
    ("bsd-3-clause", "neither the names? of .{1,80} nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "the names? of .{1,60} may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) as is and any express or implied warranties"),
    ("bsd", "use of this source code is governed by a bsd style license that can be found in the license file"),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants to recipients of software a perpetual worldwide non exclusive"),
    ("bsd-3-clause-clear", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "the png reference library is supplied as is the contributing authors and group 42 inc disclaim all warranties"),
    ("libpng", "permission is hereby granted to use copy modify and distribute this (?:source code|software) or portions hereof for any purpose without fee"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products"),
    ("ssleay", "this product includes cryptographic software written by eric young"),
    ("ssleay", "the licence and distribution terms for any publically available version or derivative of this code cannot be changed"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("postgresql", "without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("postgresql", "in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages"),
    ("ncsa", "neither the names of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission the software is provided"),
    ("ncsa", "to deal with the software without restriction including without limitation the rights to use copy modify merge"),
    ("php", "the name php must not be used to endorse or promote products derived from this software without prior written permission"),
    ("php", "products derived from this software may not be called php nor may php appear in their name"),
    ("php", "this product includes php software freely available from"),
    ("python", "psf is making python available to licensee on an as is basis"),
    ("python", "this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("cnri-python", "cnri is making python available to licensee on an as is basis"),
    ("beopen", "beopen is making the software available to licensee on an as is basis"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices"),
    ("ruby", "you may distribute the software in object code or binary form provided that you do at least one of the following"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this license text"),
    ("w3c", "permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted"),
    ("w3c", "notice of any changes or modifications (?:to the w3c files|through a copyright statement on the new code)"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("bsl", "distributed under the boost software license"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("wtfpl", "you just do what the fuck you want to"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode data files|data files)"),
    ("unicode", "this copyright and permission notice appear with all copies of the data files or software"),
    ("icu", "that the above copyright notices and this permission notice appear in all copies of the software and that both the above copyright notices"),
    ("ftl", "portions of this software are copyright .{1,40} the freetype project"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("bzip2", "this program bzip2 the associated library libbzip2 and all documentation are copyright"),
    ("info-zip", "for the purposes of this copyright and license info zip is defined as the following set of individuals"),
    ("naumen", "names? naumen .{1,40}must not be used to endorse or promote products derived from this software"),
    ("upl", "to any person obtaining a copy of this software associated documentation and or data collectively the software free of charge"),
    ("blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others may you share freely never taking more than you give"),
    ("json", "the software shall be used for good not evil"),
    # apache and its kin
    ("apache-2.0", "terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you"),
    ("apache-2.0", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", "if the work includes a notice text file as part of its distribution then any derivative works that you distribute must include a readable copy"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", "this product includes software developed by the apache software foundation"),
    ("apache-1.1", "the names apache and apache software foundation must not be used to endorse or promote products"),
    ("apache-1.0", "this product includes software developed by the apache group for use in the apache http server project"),
    ("ecl-2.0", "the educational community license version 2 0 ecl consists of the apache 2 0 license modified to change the scope of the patent grant"),
    # copyleft
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("agpl-3.0", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library)"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it"),
    ("lgpl-3.0", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-2.1", "when we speak of free software we are referring to freedom of use not price"),
    ("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", "when we speak of free software we are referring to freedom not price our general public licenses are designed to make sure that you have the freedom to distribute copies of free software and charge for them"),
    ("gpl-3.0", "to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement"),
    ("gpl-3.0", "no covered work shall be deemed part of an effective technological measure"),
    ("gpl-3.0", "you may convey verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", "you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-2.0", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended"),
    ("gpl-2.0-or-later", "gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version"),
    ("gpl-2.0-only", "under the terms of the gnu general public license version 2 only"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "this program comes with absolutely no warranty for details type show w this is free software and you are welcome to redistribute it under certain conditions"),
    ("gpl-classpath", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-gcc-exception", "you have permission to propagate a work of target code formed by combining the runtime library with independent modules"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-2.0", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("mpl", "the original code is .{1,80} the initial developer of the original code is"),
    ("npl", "the contents of this file are subject to the netscape public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "when distributing covered code include this cddl header in each file"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance"),
    ("edl", "this program and the accompanying materials are made available under the terms of the eclipse distribution license"),
    ("cpl", "the accompanying program is provided under the terms of this common public license agreement"),
    ("ipl", "the accompanying program is provided under the terms of this ibm public license agreement"),
    ("eupl", "licensed under the eupl version 1 [12] or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("osl-3.0", "licensed under the open software license version 3 0"),
    ("afl-3.0", "licensed under the academic free license version 3 0"),
    ("artistic-1.0", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("perl", "this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("cecill", "this software is governed by the cecill (?:b |c )?license under french law and abiding by the rules of distribution of free software"),
    ("cpal", "the contents of this file are subject to the common public attribution license"),
    ("rpl", "reciprocal public license the contents of this file are subject to"),
    ("qpl", "the q public license version 1 0"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the db software"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("lppl", "this work has the lppl maintenance status"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl", "no modified version of the font software may use the reserved font name"),
    ("bitstream-vera", "the fonts may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    # content and data
    ("cc0-1.0", "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights to"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share ?alike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution non ?commercial"),
    ("cc-by", "this work is licensed under (?:a|the) creative commons attribution (?:[0-9] [0-9] )?(?:international |unported )?licen[sc]e"),
    ("cc", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by", "you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-sa", "text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("odbl", "this .{1,60} is made available under the open database license"),
    ("odbl", "any rights in individual contents of the database are licensed under the database contents license"),
    ("pddl", "this .{1,60} is made available under the public domain dedication and license"),
    ("odc-by", "this .{1,60} is made available under the open data commons attribution license"),
    ("ogl-uk", "contains public sector information licensed under the open government licence"),
    ("etalab", "licence ouverte (?:open licence|etalab)"),
    ("dl-de-by", "datenlizenz deutschland namensnennung"),
    ("dl-de-zero", "datenlizenz deutschland zero"),
    ("cdla", "community data license agreement (?:permissive|sharing) version"),
    # public domain
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("public-domain", "this (?:file|work|code|software|program|document) is in the public domain"),
    ("public-domain", "(?:released|dedicated|placed) (?:in)?to? ?the public domain"),
    ("public-domain", "the author disclaims copyright to this source code"),
    ("public-domain-us", "works? of the united states government (?:and is )?not subject to copyright"),
    # source-available, models and terms that forbid
    ("sspl-1", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl-1.1", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("busl-1.1", "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features"),
    ("elastic-2.0", "you may not move change disable or circumvent the license key functionality in the software"),
    ("commons-clause", "the software is provided to you by the licensor under the license as defined below subject to the following condition"),
    ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", "any noncommercial purpose is a permitted purpose"),
    ("polyform-small-business", "use of the software for the benefit of your company is use for a permitted purpose if your company has fewer than 100 total individuals"),
    ("prosperity", "use of this software for commercial purposes is limited to a thirty day trial period"),
    ("openrail", "you agree not to use the model or derivatives of the model in any way that violates any applicable"),
    ("openrail", "use based restrictions the restrictions set forth in attachment a are considered use based restrictions"),
    ("llama", "you will not use the llama materials or any output or results of the llama materials to improve any other large language model"),
    ("llama", "greater than 700 million monthly active users in the preceding calendar month you must request a license"),
    ("gemma", "gemma is provided under and subject to the gemma terms of use"),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("ms-pl", "if you distribute any portion of the software in source code form you may do so only under this license by including a complete copy of this license"),
    ("ms-rl", "for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file"),
    ("ms-eula", "these license terms are an agreement between (?:you and )?microsoft corporation"),
    ("apple-apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("intel", "this software and the related documents are intel copyrighted materials and your use of them is governed by the express license"),
    ("nvidia", "nvidia corporation and its licensors retain all intellectual property (?:and proprietary )?rights in and to this (?:software|material)"),
    ("oracle-bcl", "oracle america inc oracle for itself and its subsidiaries and affiliates under common control is willing to license the software to you"),
    ("proprietary", "this (?:software|document|file|program) (?:is|contains) (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information|property)"),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this file |or distribution )?(?:via any medium )?is strictly prohibited"),
    ("proprietary", "no part of this (?:publication|document|work|software|book) may be reproduced"),
    ("proprietary", "may not be (?:reproduced|copied|distributed|disclosed)(?: or (?:reproduced|copied|distributed|disclosed))? without (?:the )?(?:prior |express )?(?:prior )?written (?:permission|consent)"),
    ("trial", "this (?:software|product) is licensed for evaluation purposes only"),
    ("end-user-license", "by (?:installing|downloading|using|copying)(?: or (?:installing|downloading|using|copying))? (?:the|this) (?:software|product) you (?:agree|accept)"),
    ("proprietary", "all rights reserved"),
)


@dataclass(frozen=True)
class Rule:
    """Rules stand in order of priority, which is tier first; needed are strings of which all must occur;
    sure is the confidence."""

    tier: int
    label: str
    pattern: re.Pattern[bytes]
    needed: tuple[bytes, ...]
    sure: float


def _literal(pattern: str) -> bytes:
    """The longest run of plain characters that any match of an expression contains, the space before it being one."""
    bare = re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)[?*]?|\[[^\]]*\][*?]?|\.\{\d+,\d+\}|.\?", "\0", f" {pattern}")
    return max(bare.split("\0"), key=len).rstrip().encode()


def _rule(tier: int, label: str, pattern: str, sure: float, needed: tuple[str, ...] = ()) -> Rule:
    asked = [n.encode() for n in needed] or [_literal(pattern)]
    return Rule(tier, label, re.compile(b"(?<= )" + pattern.encode() + b"(?= )"), tuple(n for n in asked if n), sure)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules: identifiers first, then signatures of texts and addresses, names with a version, names in a grant, bare names."""
    identifiers, addresses, versioned, granted, bare = [], [], [], [], []
    grant = "(?:licen[sc]ed|released|available|distributed|published|redistributed?|provided|covered|governed) (?:under|by|with)(?: the)?(?: terms of)?(?: the)?"
    for label, names, urls, versions in FAMILIES:
        words = label.replace("-", " ")
        for version in versions:
            full = f"{label}-{version}"
            digits = version.replace(".", " ")
            short = f"(?:{digits}|{digits.removesuffix(' 0')})"
            identifiers.append(_rule(0, full, f"spdx license identifier {words} {short}(?: only| or later)?", 1.0, ("spdx",)))
            for n in names:
                tail = f"(?: licen[sc]e)?(?: international| unported| generic)?,? ?(?:version |v ?|ver )?{short}(?: only| or later| or any later version| international| unported)?"
                versioned.append(_rule(2, full, f"{n}{tail}", 0.95))
        identifiers.append(_rule(0, label, f"spdx license identifier {words}", 1.0, ("spdx",)))
        for url in urls:
            addresses.append(_rule(1, label, f"(?:https? )?(?:www )?{url}(?: [0-9]+)*", 0.95, (url,)))
        for n in names:
            granted.append(_rule(3, label, f"{grant} {n}", 0.9, (_literal(n).decode(),)))
            # a name that doesn't say license is taken as one only beside that word
            says = "licen" in n or label in ("unlicense", "wtfpl", "cc0")
            bare.append(_rule(4, label, n if says or n.startswith("cc by") else f"(?:{n} licen[sc]ed?|licen[sc]ed? {n})", 0.7, (_literal(n).decode(),)))
    signatures = [_rule(1, label, text, 0.6 if label == "proprietary" else 0.9) for label, text in SIGNATURES]
    return tuple(identifiers + signatures + addresses + versioned + granted + bare)


@cache
def _gate() -> tuple[ahocorasick.Automaton, list[list[tuple[int, Rule]]]]:
    """An automaton of all strings that rules need, each with its number, and by this number the rules, with theirs, that
    need it first. One pass over a text finds which stand in it; rules of which one is missing match nowhere."""
    needed = sorted({n for rule in rules() for n in rule.needed})
    found, by_first = ahocorasick.Automaton(), [[] for _ in needed]
    for i, n in enumerate(needed):
        found.add_word(n.decode(), i)
    found.make_automaton()
    for order, rule in enumerate(rules()):
        by_first[needed.index(rule.needed[0])].append((order, rule))
    return found, by_first


def candidates(joined: bytes) -> list[tuple[int, Rule]]:
    """The rules, with their numbers, of which all that they need stands in the words."""
    automaton, by_first = _gate()
    there = {i for _, i in automaton.iter(joined.decode("latin-1"))}
    return [(order, rule) for i in there for order, rule in by_first[i] if all(n in joined for n in rule.needed[1:])]


class _Kept:
    """Intervals by start; whether one of them contains another is answered by greatest ends over prefixes of starts
    (a binary indexed tree)."""

    def __init__(self, starts: list[int]):
        self.starts, self.ends = sorted(set(starts)), [0] * (len(starts) + 1)

    def contains(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        while i > 0:
            if self.ends[i] >= end:
                return True
            i &= i - 1
        return False

    def add(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        while i < len(self.ends):
            self.ends[i] = max(self.ends[i], end)
            i += i & -i


_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Detection:
    """A label found over the words first to last."""

    label: str
    first: int
    last: int
    rule: int
    sure: float


def detect(joined: bytes) -> list[Detection]:
    """The detections in words joined by single spaces, with one before and after, that overlaps leave."""
    found = [(rule.tier, m.start() - m.end(), order, m.start(), m.end(), rule) for order, rule in candidates(joined) for m in rule.pattern.finditer(joined)]
    so_far, kept = _Kept([x[3] for x in found]), []
    for _, _, order, start, end, rule in sorted(found, key=lambda x: x[:5]):
        if not so_far.contains(start, end):
            so_far.add(start, end)
            kept.append((start, end, order, rule))
    out, at, word = [], 0, -1
    for start, end, order, rule in sorted(kept, key=lambda x: x[:3]):
        word += joined.count(b" ", at, start)
        at = start
        out.append(Detection(rule.label, word, word + joined.count(b" ", start, end), order, rule.sure))
    return out


def scan_text(text: str | None) -> tuple[int, list[tuple[str, int]], list[Detection]]:
    """The number of words, the places (phrase label, first word) of the base, and the detections of the rules."""
    words = (text or "").encode().translate(_WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in PHRASES.items():
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        before, known = 0, 0
        while at >= 0:
            known += joined.count(b" ", before, at)
            before = at
            places.append((label, known))
            at = joined.find(needle, at + 1)
    return len(words), places, detect(joined)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns one row per input row: the id column, n_words, places (label and first word of each place of
    a base phrase) and detections (label, first and last word, rule number, confidence) of the rules.

    Whole texts are read. Null and empty texts have no words. Null ids are passed on, repeated rows give
    repeated results, an empty table an empty one; other columns are not read. Ids may be of any type.
    """
    def run(ids: list, texts: list) -> tuple[list, list, list]:
        found = [scan_text(t) for t in texts]
        return (
            [n for n, _, _ in found],
            [[{"label": a, "first": b} for a, b in places] for _, places, _ in found],
            [[vars(d) for d in detections] for _, _, detections in found],
        )

    place = pa.struct([("label", pa.string()), ("first", pa.int64())])
    detection = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("rule", pa.int32()), ("sure", pa.float64())])
    return map_texts(docs, id_col, text_col, run, [("n_words", pa.int64()), ("places", pa.list_(place)), ("detections", pa.list_(detection))])


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of scan(): counts and places of the base, labels of the base and of both. score is
    the greatest confidence of what was found (a place of the base counts 0.8), 0 where nothing was."""
    def labels(column):
        return F.array_join(F.array_sort(F.array_distinct(column)), ",")

    base = F.transform("places", lambda p: p["label"])
    first = F.transform("places", lambda p: p["first"])
    sure = F.concat(F.transform("detections", lambda d: d["sure"]), F.transform("places", lambda p: F.lit(0.8)))
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )
