"""Signature rules of licenses, written one by one.

A line is: label, priority, how sure a detection is, and a regular expression over a text's words (lower case,
letters and digits and what is not ASCII, one space between words). ``_`` stands for a space that may be left
out. Priorities: 90 tags and identifiers, 80 grants, 70 bodies and headers of a license, 60 names with a
version, 50 warranty and condition clauses, 40 mentions, 20 and below what names no license.
"""

RULES = r"""
apache-2.0 | 90 | 1.0 | spdx license identifier apache 2 0
apache-1.1 | 90 | 1.0 | spdx license identifier apache 1 1
mit | 90 | 1.0 | spdx license identifier mit
mit-0 | 91 | 1.0 | spdx license identifier mit 0
bsd-2-clause | 90 | 1.0 | spdx license identifier bsd 2 clause
bsd-3-clause | 90 | 1.0 | spdx license identifier bsd 3 clause
bsd-4-clause | 90 | 1.0 | spdx license identifier bsd 4 clause
0bsd | 90 | 1.0 | spdx license identifier 0bsd
gpl-1.0 | 90 | 1.0 | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0 | 90 | 1.0 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0 | 90 | 1.0 | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2.0 | 90 | 1.0 | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 90 | 1.0 | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | 90 | 1.0 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | 90 | 1.0 | spdx license identifier agpl 3 0(?: only| or later)?
mpl-1.1 | 90 | 1.0 | spdx license identifier mpl 1 1
mpl-2.0 | 90 | 1.0 | spdx license identifier mpl 2 0
epl-1.0 | 90 | 1.0 | spdx license identifier epl 1 0
epl-2.0 | 90 | 1.0 | spdx license identifier epl 2 0
cddl-1.0 | 90 | 1.0 | spdx license identifier cddl 1 [01]
isc | 90 | 1.0 | spdx license identifier isc
zlib | 90 | 1.0 | spdx license identifier zlib
boost-1.0 | 90 | 1.0 | spdx license identifier bsl 1 0
unlicense | 90 | 1.0 | spdx license identifier unlicense
cc0-1.0 | 90 | 1.0 | spdx license identifier cc0 1 0
cc-by-4.0 | 90 | 1.0 | spdx license identifier cc by 4 0
cc-by-3.0 | 90 | 1.0 | spdx license identifier cc by 3 0
cc-by-sa-4.0 | 90 | 1.0 | spdx license identifier cc by sa 4 0
cc-by-sa-3.0 | 90 | 1.0 | spdx license identifier cc by sa 3 0
cc-by-nc-4.0 | 90 | 1.0 | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4.0 | 90 | 1.0 | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | 90 | 1.0 | spdx license identifier cc by nc nd 4 0
cc-by-nd-4.0 | 90 | 1.0 | spdx license identifier cc by nd 4 0
ofl-1.1 | 90 | 1.0 | spdx license identifier ofl 1 1
wtfpl | 90 | 1.0 | spdx license identifier wtfpl
eupl-1.2 | 90 | 1.0 | spdx license identifier eupl 1 2
odbl-1.0 | 90 | 1.0 | spdx license identifier odbl 1 0
postgresql | 90 | 1.0 | spdx license identifier postgresql
unknown | 85 | 0.5 | spdx license identifier \S+
apache-2.0 | 80 | 0.95 | licensed under the apache license version 2(?: 0)?(?: the license)?
apache-2.0 | 80 | 0.95 | (?:released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
apache | 78 | 0.85 | (?:licensed|released|distributed|available) under (?:the terms of )?(?:the |an )?apache(?: software)? licen[cs]e
mit | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |an )?(?:mit|expat)(?: x11)?(?: open source)?(?: licen[cs]e)?
mit | 79 | 0.9 | mit licensed
bsd | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?(?:modified |simplified |new |revised )?bsd(?: style)?(?: licen[cs]e)?
bsd-2-clause | 81 | 0.95 | (?:under|with) (?:the |a )?(?:2|two) clause bsd(?: licen[cs]e)?
bsd-2-clause | 81 | 0.95 | simplified bsd licen[cs]e
bsd-3-clause | 81 | 0.95 | (?:under|with) (?:the |a )?(?:3|three) clause bsd(?: licen[cs]e)?
bsd-3-clause | 81 | 0.95 | (?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | 81 | 0.9 | (?:original|old) bsd licen[cs]e
gpl | 78 | 0.9 | (?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl-2.0 | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)?_v?2(?: 0)?
gpl-3.0 | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)?_v?3(?: 0)?
lgpl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[cs]e)
agpl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[cs]e)
mpl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:mpl|mozilla public licen[cs]e)
epl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:epl|eclipse public licen[cs]e)
cddl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:cddl|common development and distribution licen[cs]e)
isc | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?isc(?: licen[cs]e)?
zlib | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?zlib(?: libpng)?(?: licen[cs]e)?
boost | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?boost(?: software)? licen[cs]e
unlicense | 80 | 0.95 | (?:licensed|released|distributed|available|published) (?:under|into|with) (?:the terms of )?(?:the )?unlicense
cc0 | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc0|cc zero|creative commons zero)
cc-by | 78 | 0.9 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc by|creative commons attribution)
cc-by-sa | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc by sa|creative commons attribution share_alike)
cc-by-nd | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc by nd|creative commons attribution no_deriv(?:s|atives?))
cc-by-nc | 79 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc by nc|creative commons attribution non_commercial)
cc-by-nc-sa | 81 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc by nc sa|creative commons attribution non_commercial share_alike)
cc-by-nc-nd | 81 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:a |the )?(?:cc by nc nd|creative commons attribution non_commercial no_deriv(?:s|atives?))
ofl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:sil )?open font licen[cs]e
artistic | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:perl )?artistic licen[cs]e
psf | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:psf|python software foundation) licen[cs]e
eupl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?(?:eupl|european union public licen[cs]e)
odbl | 80 | 0.95 | (?:licensed|released|distributed|available|published|made available) under (?:the terms of )?(?:the )?(?:odbl|open database licen[cs]e)
wtfpl | 80 | 0.95 | (?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the )?wtfpl
perl | 80 | 0.95 | (?:same terms as|under the same terms as) perl(?: itself)?
ruby | 80 | 0.9 | (?:same terms as|under the) ruby(?: s)? licen[cs]e
mit | 72 | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 70 | 0.95 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 70 | 0.6 | to permit persons to whom the software is furnished to do so the software is provided as is
x11 | 73 | 0.9 | except as contained in this notice the name of the x consortium shall not be used in advertising
bsd | 70 | 0.95 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | 69 | 0.85 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 69 | 0.85 | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause | 71 | 0.95 | neither the name of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 70 | 0.9 | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 72 | 0.95 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-attribution | 70 | 0.8 | this product includes software developed by
isc | 71 | 0.95 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 72 | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
ntp | 70 | 0.85 | permission to use copy modify and distribute this software and its documentation for any purpose
postgresql | 71 | 0.9 | without a written agreement is hereby granted provided that the above copyright notice and this paragraph
apache-2.0 | 72 | 1.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 70 | 0.95 | you may obtain a copy of the license at (?:https? )?www apache org licenses license 2 0
apache-2.0 | 70 | 0.9 | terms and conditions for use reproduction and distribution
apache-1.1 | 71 | 0.9 | this product includes software developed by the apache software foundation
apache | 66 | 0.85 | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | 70 | 0.95 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0 | 73 | 1.0 | gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version
gpl-3.0 | 73 | 1.0 | gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version
gpl-2.0 | 72 | 0.95 | gnu general public license version 2 as published by the free software foundation
gpl-3.0 | 72 | 0.95 | gnu general public license version 3 as published by the free software foundation
gpl | 68 | 0.9 | you should have received a copy of the gnu general public license
gpl | 66 | 0.8 | see the gnu general public license for more details
lgpl | 70 | 0.95 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 68 | 0.9 | you should have received a copy of the gnu (?:lesser|library) general public license
lgpl-2.1 | 73 | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3.0 | 73 | 1.0 | gnu lesser general public license as published by the free software foundation either version 3 of the license
agpl-3.0 | 73 | 1.0 | gnu affero general public license as published by the free software foundation either version 3 of the license
agpl | 68 | 0.9 | you should have received a copy of the gnu affero general public license
agpl | 67 | 0.8 | remote network interaction use with the gnu general public license
gpl-classpath | 72 | 0.9 | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gfdl | 72 | 0.95 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 60 | 0.8 | gnu free documentation license
mpl-2.0 | 72 | 1.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | 72 | 1.0 | the contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | 70 | 0.9 | if a copy of the mpl was not distributed with this file you can obtain one at
npl | 71 | 0.9 | the contents of this file are subject to the netscape public license
epl-1.0 | 72 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0
epl-2.0 | 73 | 0.95 | made available under the terms of the eclipse public license (?:v |version )?2 0
cpl-1.0 | 70 | 0.95 | made available under the terms of the common public license(?: v| version)? ?1 0
cddl-1.0 | 72 | 0.95 | the contents of this file are subject to the terms of the common development and distribution license
zlib | 72 | 0.95 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
zlib | 71 | 0.9 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost-1.0 | 72 | 0.95 | distributed under the boost software license version 1 0
boost-1.0 | 72 | 0.95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense | 72 | 1.0 | this is free and unencumbered software released into the public domain
unlicense | 71 | 0.95 | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1.0 | 72 | 0.95 | to the extent possible under law (?:\S+ ){1,12}?has waived all copyright and related or neighboring rights
cc0-1.0 | 70 | 0.9 | no copyright the person who associated a work with this deed has dedicated the work to the public domain
wtfpl | 72 | 1.0 | do what the fuck you want to public license
wtfpl | 71 | 0.95 | you just do what the fuck you want to
artistic-2.0 | 71 | 0.9 | this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0
artistic-1.0 | 70 | 0.85 | the intent of this document is to state the conditions under which a package may be copied
ofl-1.1 | 72 | 0.95 | this font software is licensed under the sil open font license version 1 1
ofl | 70 | 0.9 | reserved font name
psf-2.0 | 71 | 0.9 | python software foundation license version 2
psf | 70 | 0.85 | psf hereby grants licensee a nonexclusive royalty free world wide license
openssl | 72 | 0.95 | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | 71 | 0.9 | this product includes cryptographic software written by eric young
php | 72 | 0.9 | this product includes php software freely available from
php | 60 | 0.85 | (?:the )?php license(?: version)? 3 0[01]?
ijg | 71 | 0.9 | this software is based in part on the work of the independent jpeg group
freetype | 71 | 0.9 | portions of this software are copyright (?:\S+ ){0,4}?the freetype project
libpng | 71 | 0.9 | the png reference library is supplied as is
curl | 71 | 0.85 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
icu | 71 | 0.85 | provided that the above copyright notice s and this permission notice appear in all copies of the software
unicode | 71 | 0.9 | unicode license agreement data files and software
unicode | 70 | 0.85 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
json | 72 | 0.95 | the software shall be used for good not evil
beerware | 72 | 0.95 | as long as you retain this notice you can do whatever you want with this stuff
beerware | 71 | 0.9 | the beer_ware license
ms-pl | 70 | 0.9 | microsoft public license
ms-rl | 70 | 0.9 | microsoft reciprocal license
ms-eula | 70 | 0.85 | microsoft software license terms
cecill | 70 | 0.9 | cecill(?: [abc])?(?: free software)? licen[cs]e
qpl | 70 | 0.9 | q public license version 1 0
ipl-1.0 | 70 | 0.9 | ibm public license version 1 0
apsl-2.0 | 70 | 0.9 | apple public source license version 2 0
sleepycat | 70 | 0.85 | redistributions in any form must be accompanied by information on how to obtain complete source code
vim | 70 | 0.85 | vim license
w3c | 70 | 0.9 | w3c software(?: and document)? notice and license
zpl-2.1 | 70 | 0.9 | zope public license zpl version 2 [01]
osl-3.0 | 70 | 0.9 | licensed under the open software license version 3 0
afl-3.0 | 70 | 0.9 | licensed under the academic free license version 3 0
ncsa | 70 | 0.9 | university of illinois ncsa open source license
naist | 69 | 0.8 | nara institute of science and technology
hpnd | 69 | 0.8 | historical permission notice and disclaimer
tcl | 70 | 0.85 | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose
ecl-2.0 | 70 | 0.9 | educational community license version 2 0
upl-1.0 | 70 | 0.9 | universal permissive license(?: v| version)? ?1 0
blueoak-1.0.0 | 70 | 0.9 | blue oak model license(?: version)? 1 0 0
mulan-2.0 | 70 | 0.9 | mulan (?:psl v2|permissive software license version 2)
eupl-1.2 | 70 | 0.95 | european union public licen[cs]e(?: v| version)? ?1 2
eupl-1.1 | 70 | 0.95 | european union public licen[cs]e(?: v| version)? ?1 1
odbl-1.0 | 71 | 0.95 | open database licen[cs]e(?: odbl)?(?: v| version)? ?1 0
odc-by | 70 | 0.9 | open data commons attribution licen[cs]e
pddl | 70 | 0.9 | (?:open data commons )?public domain dedication and licen[cs]e
ogl-uk | 70 | 0.9 | open government licen[cs]e(?: v| version)? ?[123](?: 0)?
cdla-permissive | 70 | 0.9 | community data license agreement permissive
cdla-sharing | 70 | 0.9 | community data license agreement sharing
sspl-1.0 | 71 | 0.95 | server side public license
elastic-2.0 | 71 | 0.95 | elastic license(?: v| version)? ?2(?: 0)?
busl-1.1 | 71 | 0.95 | business source license(?: v| version)? ?1 1
commons-clause | 72 | 0.95 | commons clause license condition
polyform-nc | 71 | 0.9 | polyform noncommercial license
polyform | 68 | 0.85 | polyform (?:shield|strict|perimeter|small business|free trial|internal use) license
confluent | 70 | 0.9 | confluent community license
openrail | 70 | 0.9 | (?:creativeml |bigscience |bigcode )?open_rail(?: m)?(?: licen[cs]e)?
llama | 70 | 0.9 | llama \d?(?: \d)? ?community license agreement
gemma | 69 | 0.85 | gemma terms of use
cc-by-4.0 | 70 | 0.95 | creative commons attribution 4 0 international(?: public)?(?: licen[cs]e)?
cc-by-3.0 | 70 | 0.95 | creative commons attribution 3 0 (?:unported|united states|\S+)(?: licen[cs]e)?
cc-by-2.5 | 70 | 0.9 | creative commons attribution 2 5(?: generic)?(?: licen[cs]e)?
cc-by-2.0 | 70 | 0.9 | creative commons attribution 2 0(?: generic)?(?: licen[cs]e)?
cc-by-sa-4.0 | 70 | 0.95 | creative commons attribution share_alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-sa-3.0 | 70 | 0.95 | creative commons attribution share_alike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-4.0 | 70 | 0.95 | creative commons attribution non_commercial 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-3.0 | 70 | 0.95 | creative commons attribution non_commercial 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-sa-4.0 | 70 | 0.95 | creative commons attribution non_commercial share_alike 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-sa-3.0 | 70 | 0.95 | creative commons attribution non_commercial share_alike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-nd-4.0 | 70 | 0.95 | creative commons attribution non_commercial no_deriv(?:s|atives?) 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-nc-nd-3.0 | 70 | 0.95 | creative commons attribution non_commercial no_deriv(?:s|atives?) 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nd-4.0 | 70 | 0.95 | creative commons attribution no_deriv(?:s|atives?) 4 0(?: international)?(?: public)?(?: licen[cs]e)?
cc-by-4.0 | 70 | 0.95 | creativecommons org licenses by 4 0
cc-by-3.0 | 70 | 0.95 | creativecommons org licenses by 3 0
cc-by-sa-4.0 | 70 | 0.95 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 70 | 0.95 | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | 70 | 0.95 | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 70 | 0.95 | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 70 | 0.95 | creativecommons org licenses by nc nd 4 0
cc-by-nd-4.0 | 70 | 0.95 | creativecommons org licenses by nd 4 0
cc0-1.0 | 70 | 0.95 | creativecommons org publicdomain zero 1 0
public-domain-mark | 70 | 0.9 | creativecommons org publicdomain mark 1 0
gpl | 65 | 0.9 | www gnu org licenses(?: gpl)?(?: (?:2|3) 0)?
lgpl | 66 | 0.9 | www gnu org licenses lgpl(?: (?:2|3) [01])?
agpl | 66 | 0.9 | www gnu org licenses agpl(?: 3 0)?
mit | 66 | 0.95 | opensource org licenses mit(?: license)?
bsd | 66 | 0.9 | opensource org licenses bsd(?: [23] clause| license)?
mpl-2.0 | 66 | 0.95 | (?:www )?mozilla org (?:en us )?mpl 2 0
epl | 66 | 0.9 | www eclipse org legal epl(?: v[12]0| 2 0)?
boost-1.0 | 66 | 0.95 | www boost org license 1 0
ofl | 66 | 0.95 | scripts sil org ofl
apache-2.0 | 60 | 0.85 | apache(?: software)? license(?: version| v)? 2 0
apache-1.1 | 60 | 0.85 | apache(?: software)? license(?: version| v)? 1 1
apache-1.0 | 60 | 0.85 | apache(?: software)? license(?: version| v)? 1 0
gpl-1.0 | 60 | 0.8 | gnu (?:gpl|general public licen[cs]e)(?: version| v)?_v?1(?: 0)?
gpl-2.0 | 60 | 0.85 | gnu (?:gpl|general public licen[cs]e)(?: version| v)?_v?2(?: 0)?
gpl-3.0 | 60 | 0.85 | gnu (?:gpl|general public licen[cs]e)(?: version| v)?_v?3(?: 0)?
gpl-2.0 | 59 | 0.8 | gpl_v2(?: 0)?
gpl-3.0 | 59 | 0.8 | gpl_v3(?: 0)?
lgpl-2.1 | 60 | 0.85 | (?:lgpl|lesser general public licen[cs]e)(?: version| v)?_v?2 1
lgpl-3.0 | 60 | 0.85 | (?:lgpl|lesser general public licen[cs]e)(?: version| v)?_v?3(?: 0)?
lgpl-2.0 | 60 | 0.85 | library general public licen[cs]e(?: version| v)?_v?2(?: 0)?
agpl-3.0 | 60 | 0.85 | (?:agpl|affero general public licen[cs]e)(?: version| v)?_v?3(?: 0)?
mpl-2.0 | 60 | 0.85 | (?:mpl|mozilla public licen[cs]e)(?: version| v)? 2 0
mpl-1.1 | 60 | 0.85 | (?:mpl|mozilla public licen[cs]e)(?: version| v)? 1 1
epl-2.0 | 60 | 0.85 | eclipse public licen[cs]e(?: version| v)? 2 0
epl-1.0 | 60 | 0.85 | eclipse public licen[cs]e(?: version| v)? 1 0
cddl-1.0 | 60 | 0.85 | common development and distribution licen[cs]e(?: cddl)?(?: version| v)? 1 [01]
boost-1.0 | 60 | 0.85 | boost software license(?: version| v)? 1 0
artistic-2.0 | 60 | 0.8 | artistic license(?: version| v)? 2 0
artistic-1.0 | 60 | 0.8 | artistic license(?: version| v)? 1 0
ofl-1.1 | 60 | 0.85 | open font license(?: version| v)? 1 1
ofl-1.0 | 60 | 0.85 | open font license(?: version| v)? 1 0
mit | 55 | 0.75 | (?:see|read|view) the mit license
apache | 55 | 0.75 | (?:see|read|view) the apache license
gpl | 55 | 0.75 | (?:see|read|view) the (?:gnu )?(?:gpl|general public license)
dual | 55 | 0.7 | dual licensed(?: under)?
dual | 54 | 0.65 | at your option under (?:either|any) of
warranty-none | 50 | 0.5 | without warranty of any kind express or implied
warranty-none | 50 | 0.5 | without warranties or conditions of any kind
warranty-none | 50 | 0.5 | without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
warranty-none | 49 | 0.45 | including but not limited to the (?:implied )?warranties of merchantability
liability-none | 50 | 0.5 | in no event shall the (?:authors?|copyright (?:holders?|owners?)|contributors)(?: or (?:copyright holders|contributors))? be liable
liability-none | 49 | 0.45 | in no event will the authors? be held liable
patent-grant | 50 | 0.6 | perpetual worldwide non exclusive no charge royalty free irrevocable
copyleft | 50 | 0.6 | derivative works? must be (?:licensed|distributed) under the same (?:terms|license)
attribution | 50 | 0.5 | you must give appropriate credit provide a link to the license
share-alike | 50 | 0.6 | you must distribute your contributions under the same license as the original
non-commercial | 50 | 0.6 | you may not use the material for commercial purposes
non-commercial | 45 | 0.5 | for (?:non commercial|noncommercial)(?: research| educational| personal)? (?:use|purposes) only
research-only | 45 | 0.5 | for research purposes only
no-derivatives | 50 | 0.6 | you may not distribute the modified material
isc | 45 | 0.6 | isc license
zlib | 45 | 0.6 | zlib(?: libpng)? license
unlicense | 45 | 0.6 | the unlicense
cc0 | 45 | 0.6 | cc0 1 0(?: universal)?
public-domain | 65 | 0.8 | (?:released|placed|dedicated)(?: in)?(?:to)? the public domain
public-domain | 44 | 0.5 | (?:is|are) in the public domain
open-source | 30 | 0.4 | open source license
proprietary | 35 | 0.6 | (?:proprietary and confidential|confidential and proprietary)
proprietary | 35 | 0.6 | unauthorized copying of this file via any medium is strictly prohibited
proprietary | 34 | 0.55 | no part of this (?:publication|book|document|work) may be reproduced
proprietary | 34 | 0.55 | (?:may not|must not) be (?:copied|reproduced|redistributed) without (?:the )?(?:prior |express )?(?:written )?permission
proprietary | 33 | 0.5 | end user license agreement
proprietary | 32 | 0.5 | trade secrets? of
proprietary | 20 | 0.4 | all rights reserved
terms-of-use | 20 | 0.3 | subject to (?:the|our) terms of (?:use|service)
unknown | 5 | 0.3 | licensed under
"""
