"""The signature table of the license scan, written by hand.

A line: label, priority, confidence, keyword (several parted by |, one of which the pattern implies)
and pattern, parted by two spaces or more. Patterns are tried on folded text: lower case, each run
of white space and of comment marks after a line break one space, quotation marks straight.
Priorities: 4 identifiers and body texts, 3 grants and notices that name a license and its version,
2 names with a version and addresses, 1 bare names, 0 hints. Patterns hold no single quote.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    """A signature: the pattern is tried on texts that contain one of the keywords."""

    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str


TABLE = r"""
# identifiers
apache-1.0  4  0.99  spdx  spdx-license-identifier: ?apache-1\.0\b
apache-1.1  4  0.99  spdx  spdx-license-identifier: ?apache-1\.1\b
apache-2  4  0.99  spdx  spdx-license-identifier: ?apache-2(?:\.0)?\b
mit  4  0.99  spdx  spdx-license-identifier: ?\(?mit(?![\w-])
mit-0  4  0.99  spdx  spdx-license-identifier: ?mit-0\b
bsd-2-clause  4  0.99  spdx  spdx-license-identifier: ?bsd-2-clause\b
bsd-3-clause  4  0.99  spdx  spdx-license-identifier: ?bsd-3-clause\b
bsd-4-clause  4  0.99  spdx  spdx-license-identifier: ?bsd-4-clause\b
0bsd  4  0.99  spdx  spdx-license-identifier: ?0bsd\b
isc  4  0.99  spdx  spdx-license-identifier: ?isc\b
zlib  4  0.99  spdx  spdx-license-identifier: ?zlib\b
bsl-1.0  4  0.99  spdx  spdx-license-identifier: ?bsl-1\.0\b
busl-1.1  4  0.99  spdx  spdx-license-identifier: ?busl-1\.1\b
gpl-1  4  0.99  spdx  spdx-license-identifier: ?\(?gpl-1\.0(?:-only|-or-later|\+)?(?![\w.])
gpl-2  4  0.99  spdx  spdx-license-identifier: ?\(?gpl-2\.0(?:-only|-or-later|\+)?(?![\w.])
gpl-3  4  0.99  spdx  spdx-license-identifier: ?\(?gpl-3\.0(?:-only|-or-later|\+)?(?![\w.])
lgpl-2  4  0.99  spdx  spdx-license-identifier: ?\(?lgpl-2\.0(?:-only|-or-later|\+)?(?![\w.])
lgpl-2.1  4  0.99  spdx  spdx-license-identifier: ?\(?lgpl-2\.1(?:-only|-or-later|\+)?(?![\w.])
lgpl-3  4  0.99  spdx  spdx-license-identifier: ?\(?lgpl-3\.0(?:-only|-or-later|\+)?(?![\w.])
agpl-1  4  0.99  spdx  spdx-license-identifier: ?agpl-1\.0(?:-only|-or-later)?(?![\w.])
agpl-3  4  0.99  spdx  spdx-license-identifier: ?agpl-3\.0(?:-only|-or-later)?(?![\w.])
gfdl-1.1  4  0.99  spdx  spdx-license-identifier: ?gfdl-1\.1
gfdl-1.2  4  0.99  spdx  spdx-license-identifier: ?gfdl-1\.2
gfdl-1.3  4  0.99  spdx  spdx-license-identifier: ?gfdl-1\.3
mpl-1.0  4  0.99  spdx  spdx-license-identifier: ?mpl-1\.0\b
mpl-1.1  4  0.99  spdx  spdx-license-identifier: ?mpl-1\.1\b
mpl-2.0  4  0.99  spdx  spdx-license-identifier: ?mpl-2\.0\b
epl-1.0  4  0.99  spdx  spdx-license-identifier: ?epl-1\.0\b
epl-2.0  4  0.99  spdx  spdx-license-identifier: ?epl-2\.0\b
eupl-1.1  4  0.99  spdx  spdx-license-identifier: ?eupl-1\.1\b
eupl-1.2  4  0.99  spdx  spdx-license-identifier: ?eupl-1\.2\b
cddl-1.0  4  0.99  spdx  spdx-license-identifier: ?cddl-1\.0\b
cddl-1.1  4  0.99  spdx  spdx-license-identifier: ?cddl-1\.1\b
cpl-1.0  4  0.99  spdx  spdx-license-identifier: ?cpl-1\.0\b
osl-3.0  4  0.99  spdx  spdx-license-identifier: ?osl-3\.0\b
afl-3.0  4  0.99  spdx  spdx-license-identifier: ?afl-3\.0\b
artistic-1.0  4  0.99  spdx  spdx-license-identifier: ?artistic-1\.0\b
artistic-2.0  4  0.99  spdx  spdx-license-identifier: ?artistic-2\.0\b
unlicense  4  0.99  spdx  spdx-license-identifier: ?unlicense\b
wtfpl  4  0.99  spdx  spdx-license-identifier: ?wtfpl\b
cc0-1.0  4  0.99  spdx  spdx-license-identifier: ?cc0-1\.0\b
cc-by-3.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-3\.0\b
cc-by-4.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-4\.0\b
cc-by-sa-3.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-sa-3\.0\b
cc-by-sa-4.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-sa-4\.0\b
cc-by-nd-4.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-nd-4\.0\b
cc-by-nc-4.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-nc-4\.0\b
cc-by-nc-sa-4.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-nc-sa-4\.0\b
cc-by-nc-nd-4.0  4  0.99  spdx  spdx-license-identifier: ?cc-by-nc-nd-4\.0\b
odbl-1.0  4  0.99  spdx  spdx-license-identifier: ?odbl-1\.0\b
ofl-1.1  4  0.99  spdx  spdx-license-identifier: ?ofl-1\.1\b
psf-2  4  0.99  spdx  spdx-license-identifier: ?(?:psf-2\.0|python-2\.0)\b
postgresql  4  0.99  spdx  spdx-license-identifier: ?postgresql\b
ncsa  4  0.99  spdx  spdx-license-identifier: ?ncsa\b
sspl-1  4  0.99  spdx  spdx-license-identifier: ?sspl-1\.0\b
elastic-2.0  4  0.99  spdx  spdx-license-identifier: ?elastic-2\.0\b
upl-1.0  4  0.99  spdx  spdx-license-identifier: ?upl-1\.0\b
ms-pl  4  0.99  spdx  spdx-license-identifier: ?ms-pl\b
ms-rl  4  0.99  spdx  spdx-license-identifier: ?ms-rl\b
ecl-2.0  4  0.99  spdx  spdx-license-identifier: ?ecl-2\.0\b
unknown-license  0  0.5  spdx  spdx-license-identifier: ?[\w.+-]+

# body texts
mit  4  0.97  permission  permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit  4  0.9  substantial portions  the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0  4  0.9  permission  permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "software"\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\. the software is provided
mit  3  0.7  noninfringement  the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement
x11  4  0.9  x consortium  except as contained in this notice, the name of the x consortium shall not be used in advertising
isc  4  0.97  permission  permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
0bsd  4  0.97  permission  permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\.
hpnd  4  0.9  permission  permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted
postgresql  4  0.95  written agreement  permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
bsd  3  0.85  redistribution  redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd-3-clause  4  0.95  endorse  neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-3-clause  4  0.9  endorse  the names? of (?:the )?(?:author|contributors?|copyright holders?)s? may not be used to endorse or promote products derived from this software
bsd-4-clause  4  0.95  advertising  all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd  3  0.7  redistributions  redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd  3  0.7  redistributions  redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
bsd  3  0.6  as is  this software is provided by the (?:copyright holders?|regents|author)s?(?: and contributors)? "as is" and any express or implied warranties
bsd-2-clause  4  0.85  freebsd  the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies.{0,60}freebsd
zlib  4  0.95  misrepresented  the origin of this software must not be misrepresented; you must not claim that you wrote the original software
zlib  4  0.85  altered source  altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib  3  0.7  express or implied  this software is provided "?as-is"?, without any express or implied warranty\. in no event will the authors be held liable
bsl-1.0  4  0.97  permission  permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
apache-2  4  0.97  apache  licensed under the apache license, version 2\.0 \(the "license"\); you may not use this file except in compliance with the license
apache-2  3  0.9  apache  you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0
apache-2  4  0.95  perpetual  each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) license
apache-2  3  0.6  applicable law  unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis.{0,140}(?:in compliance|limitations under the license)
apache-2  3  0.6  specific language  see the license for the specific language governing permissions and limitations under the license
apache-1.1  4  0.95  apache  the end-user documentation included with the redistribution, if any, must include the following acknowledge?ment: "?this product includes software developed by the apache
apache-1.1  4  0.9  apache  products derived from this software may not be called "apache"
apache-2  2  0.7  contributor license  licensed to the apache software foundation \(asf\) under one or more contributor license agreements
gpl  3  0.9  free software  this program is free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license
gpl-2  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?[;,] (?:either )?version 2\b
gpl-3  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?[;,] (?:either )?version 3\b
gpl-1  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu general public license(?: as published by the free software foundation)?[;,] (?:either )?version 1\b
lgpl-2  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu library general public license(?: as published by the free software foundation)?[;,] (?:either )?version 2\b(?!\.1)
lgpl-2.1  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu lesser general public license(?: as published by the free software foundation)?[;,] (?:either )?version 2\.1\b
lgpl-3  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu lesser general public license(?: as published by the free software foundation)?[;,] (?:either )?version 3\b
agpl-3  4  0.97  free software  free software[:;] you can redistribute it and/or modify it under the terms of the gnu affero general public license(?: as published by the free software foundation)?[;,] (?:either )?version 3\b
gpl  3  0.7  gnu general public  you should have received a copy of the gnu general public license along with
lgpl  3  0.7  general public  you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl  3  0.7  affero  you should have received a copy of the gnu affero general public license along with
gpl  3  0.6  gnu general public  see the gnu general public license for more details
lgpl  3  0.6  general public  see the gnu (?:lesser|library) general public license for more details
agpl  3  0.6  affero  see the gnu affero general public license for more details
gpl-2  4  0.95  gnu general public  gnu general public license version 2, june 1991
gpl-3  4  0.95  gnu general public  gnu general public license version 3, 29 june 2007
lgpl-2.1  4  0.95  lesser general  gnu lesser general public license version 2\.1, february 1999
lgpl-3  4  0.95  lesser general  gnu lesser general public license version 3, 29 june 2007
agpl-3  4  0.95  affero  gnu affero general public license version 3, 19 november 2007
gpl  3  0.8  take away your freedom  the licenses for most software are designed to take away your freedom to share and change it
gpl-3  4  0.9  copyleft  the gnu general public license is a free, copyleft license for software and other kinds of works
agpl-3  4  0.9  copyleft  the gnu affero general public license is a free, copyleft license for software and other kinds of works
classpath-exception  4  0.9  linking  linking this (?:library|program) statically or dynamically with other modules is making a combined work based on this
gfdl  4  0.95  free documentation  permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
gfdl  3  0.7  invariant sections  with no invariant sections, no front-cover texts,? and no back-cover texts
mpl-1.1  4  0.97  mozilla  the contents of this file are subject to the mozilla public license version 1\.1
mpl-1.0  4  0.97  mozilla  the contents of this file are subject to the mozilla public license version 1\.0
mpl-2.0  4  0.97  mozilla  this source code form is subject to the terms of the mozilla public license, v\. ?2\.0
mpl-2.0  3  0.8  mozilla  if a copy of the mpl was not distributed with this file, you can obtain one at https?://(?:www\.)?mozilla\.org/mpl/2\.0
npl-1.1  4  0.9  netscape  the contents of this file are subject to the netscape public license
epl-1.0  4  0.97  eclipse  are made available under the terms of the eclipse public license v(?:ersion )? ?1\.0
epl-2.0  4  0.97  eclipse  are made available under the terms of the eclipse public license (?:v(?:ersion )? ?)?2\.0
cddl-1.0  4  0.95  common development  the contents of this file are subject to the terms of the common development and distribution license
cpl-1.0  4  0.95  common public  made available under the terms of the common public license v(?:ersion )? ?1\.0
cpal-1.0  4  0.95  common public  the contents of this file are subject to the common public attribution license version 1\.0
eupl  4  0.9  european union public  you may not use this work except in compliance with the licen[cs]e.{0,200}european union public licen[cs]e
osl-3.0  4  0.9  open software  licensed under the open software license version 3\.0
afl-3.0  4  0.9  academic free  licensed under the academic free license version 3\.0
artistic-1.0  4  0.9  artistic  the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control
artistic-2.0  4  0.9  package  this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed
perl  3  0.85  perl  (?:you can|may) redistribute it and/or modify it under the same terms as perl
ruby  3  0.85  ruby  distributed under the same (?:license|terms) as ruby
unlicense  4  0.97  unencumbered  this is free and unencumbered software released into the public domain
wtfpl  4  0.97  what the fuck  do what the fuck you want to public license
beerware-42  4  0.95  beer  as long as you retain this notice you can do whatever you want with this stuff\. if we meet some day.{0,60}\bbeer
cc0-1.0  4  0.95  neighboring rights  to the extent possible under law.{0,120}has waived all copyright and related or neighboring rights
cc0-1.0  4  0.95  cc0  cc0 1\.0 universal
cc-by-4.0  4  0.95  creative commons  creative commons attribution 4\.0 international(?: public)? licen[cs]e
cc-by-sa-4.0  4  0.95  creative commons  creative commons attribution-sharealike 4\.0 international(?: public)? licen[cs]e
cc-by-nc-4.0  4  0.95  creative commons  creative commons attribution-noncommercial 4\.0 international(?: public)? licen[cs]e
cc-by-nd-4.0  4  0.95  creative commons  creative commons attribution-noderivatives 4\.0 international(?: public)? licen[cs]e
cc-by-nc-sa-4.0  4  0.95  creative commons  creative commons attribution-noncommercial-sharealike 4\.0 international(?: public)? licen[cs]e
cc-by-nc-nd-4.0  4  0.95  creative commons  creative commons attribution-noncommercial-noderivatives 4\.0 international(?: public)? licen[cs]e
cc-by-3.0  4  0.95  creative commons  creative commons attribution 3\.0 (?:unported|united states|germany|[a-z]+)(?: licen[cs]e)
cc-by-sa-3.0  4  0.95  creative commons  creative commons attribution-share ?alike 3\.0 (?:unported|united states|germany|[a-z]+)(?: licen[cs]e)
ofl-1.1  4  0.95  font software  this font software is licensed under the sil open font license, version 1\.1
ofl  3  0.8  font software  the font software may be sold as part of a larger software package but no copy of one or more of the original
ncsa  4  0.9  contributors  neither the names of .{1,160}?, nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
openssl  4  0.9  openssl  this product includes software developed by the openssl project for use in the openssl toolkit
ssleay  4  0.9  eric young  this product includes cryptographic software written by eric young
php-3.01  4  0.9  php  this product includes php software, freely available from
psf-2  4  0.9  python software foundation  this license agreement is between the python software foundation \("?psf"?\)
elastic-2.0  4  0.9  managed service  you may not provide the software to third parties as a hosted or managed service
busl-1.1  4  0.9  production use  the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
json  4  0.9  shall be used for good  the software shall be used for good, not evil
ms-pl  4  0.85  microsoft public  this license governs use of the accompanying software.{0,400}microsoft public licen[cs]e
unicode  4  0.85  unicode  permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
icu  4  0.8  icu  icu license - icu 1\.8\.1 and later
ijg  4  0.85  jpeg group  this software is based in part on the work of the independent jpeg group
tcl  4  0.85  tcl  the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose.{0,400}tcl
hpnd  3  0.6  suitability  makes no representations about the suitability (?:of )?this software for any purpose\. it is provided "as is" without express or implied warranty
openldap  4  0.9  openldap  the openldap public license
w3c  4  0.85  w3c  permission to copy, modify, and distribute this (?:software|work).{0,120}w3c
ecl-2.0  4  0.9  educational community  licensed under the educational community license, version 2\.0
nasa-1.3  4  0.9  nasa  nasa open source agreement version 1\.3
intel  4  0.8  intel  intel open source license
sgi-b-2.0  4  0.9  sgi  sgi free software license b

# grants with a version
apache-2  3  0.95  apache  (?:licen[cs]ed|released|distributed|available|covered|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e,?(?: \(?(?:version|v\.?|ver\.?))? ?2(?:\.0)?\b
mit  3  0.95  mit|expat  (?:licen[cs]ed|released|distributed|available|covered|published) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?:/x11)? licen[cs]e
bsd-3-clause  3  0.95  bsd  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?(?:3-clause|three-clause|new|modified|revised) bsd
bsd-2-clause  3  0.95  bsd  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?(?:2-clause|two-clause|simplified) bsd
bsd  3  0.85  bsd  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the |a )?bsd(?:[- ]style)? licen[cs]e
gpl-1  3  0.95  gpl|general public  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?\(?(?:gpl\)?,? ?)?(?:version|v\.?|ver\.?|-)? ?1(?:\.0)?\b(?!\.)
gpl-2  3  0.95  gpl|general public  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?\(?(?:gpl\)?,? ?)?(?:version|v\.?|ver\.?|-)? ?2(?:\.0)?\b(?!\.)
gpl-3  3  0.95  gpl|general public  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?\(?(?:gpl\)?,? ?)?(?:version|v\.?|ver\.?|-)? ?3(?:\.0)?\b(?!\.)
lgpl-2.1  3  0.95  lgpl|general public  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version|v\.?|ver\.?|-)? ?2\.1\b
lgpl-3  3  0.95  lgpl|general public  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?(?:version|v\.?|ver\.?|-)? ?3(?:\.0)?\b
agpl-3  3  0.95  agpl|affero  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl),? ?(?:version|v\.?|ver\.?|-)? ?3(?:\.0)?\b
mpl-2.0  3  0.95  mpl|mozilla  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:mozilla public licen[cs]e|mpl),? ?(?:version|v\.?|ver\.?|-)? ?2(?:\.0)?\b
isc  3  0.9  isc  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
cc0-1.0  3  0.95  cc0  (?:licen[cs]ed|released|distributed|available|dedicated) (?:under|to) (?:the )?(?:public domain under )?(?:the )?(?:creative commons )?cc0(?: 1\.0)?
cc-by  3  0.9  creative commons  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?creative commons attribution licen[cs]e
cc-by-4.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]4\.0\b
cc-by-sa-4.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]sa[ -]4\.0\b
cc-by-nd-4.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]nd[ -]4\.0\b
cc-by-nc-4.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]nc[ -]4\.0\b
cc-by-nc-sa-4.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]nc[ -]sa[ -]4\.0\b
cc-by-nc-nd-4.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]nc[ -]nd[ -]4\.0\b
cc-by-3.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]3\.0\b
cc-by-sa-3.0  3  0.95  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]sa[ -]3\.0\b
cc-by  3  0.9  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by\b(?![ -](?:nc|sa|nd|\d))
cc-by-sa  3  0.9  cc by|cc-by  (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the |a )?cc[ -]by[ -]sa\b(?![ -]\d)
unlicense  3  0.9  unlicense  (?:licen[cs]ed|released|distributed|available) under (?:the )?unlicense
zlib  3  0.9  zlib  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?:/libpng)? licen[cs]e
bsl-1.0  3  0.9  boost  (?:distributed|licen[cs]ed|released) under (?:the )?boost software licen[cs]e,? ?(?:version|v\.?)? ?1\.0
ofl-1.1  3  0.9  open font  (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:sil )?open font licen[cs]e
wtfpl  3  0.9  wtfpl  (?:licen[cs]ed|released|distributed|available) under (?:the )?wtfpl
perl  3  0.85  perl  (?:licen[cs]ed|released|distributed|available) under the same terms as perl
gpl-2  3  0.85  linux  (?:licen[cs]ed|released|distributed|available) under the same (?:licen[cs]e|terms) as the linux kernel
mit  3  0.9  license  "license" ?: ?"mit"
apache-2  3  0.9  license  "license" ?: ?"apache-2\.0"
isc  3  0.9  license  "license" ?: ?"isc"
bsd-3-clause  3  0.9  license  "license" ?: ?"bsd-3-clause"
bsd-2-clause  3  0.9  license  "license" ?: ?"bsd-2-clause"
gpl-2  3  0.9  license  "license" ?: ?"gpl-2\.0(?:-only|-or-later|\+)?"
gpl-3  3  0.9  license  "license" ?: ?"gpl-3\.0(?:-only|-or-later|\+)?"
mpl-2.0  3  0.9  license  "license" ?: ?"mpl-2\.0"
unlicense  3  0.9  license  "license" ?: ?"unlicense"
mit  3  0.9  license  \blicense ?= ?"mit"
apache-2  3  0.9  license  \blicense ?= ?"(?:mit or )?apache-2\.0"
mit  3  0.85  osi approved  license :: osi approved :: mit licen[cs]e
apache-2  3  0.85  osi approved  license :: osi approved :: apache software licen[cs]e
bsd  3  0.85  osi approved  license :: osi approved :: bsd licen[cs]e
gpl-2  3  0.85  osi approved  license :: osi approved :: gnu general public licen[cs]e v2
gpl-3  3  0.85  osi approved  license :: osi approved :: gnu general public licen[cs]e v3
lgpl-3  3  0.85  osi approved  license :: osi approved :: gnu lesser general public licen[cs]e v3
agpl-3  3  0.85  osi approved  license :: osi approved :: gnu affero general public licen[cs]e v3
mpl-2.0  3  0.85  osi approved  license :: osi approved :: mozilla public licen[cs]e 2\.0
isc  3  0.85  osi approved  license :: osi approved :: isc licen[cs]e
gpl-2  3  0.85  module_license  module_license ?\( ?"gpl(?: v2)?" ?\)
mit  3  0.85  module_license  module_license ?\( ?"(?:dual )?mit(?:/gpl)?" ?\)
proprietary  3  0.8  module_license  module_license ?\( ?"proprietary" ?\)

# names with a version
apache-1.0  2  0.9  apache  apache(?: software)? licen[cs]e,? ?\(?(?:version|v\.?|ver\.?)? ?1\.0\b
apache-1.1  2  0.9  apache  apache(?: software)? licen[cs]e,? ?\(?(?:version|v\.?|ver\.?)? ?1\.1\b
apache-2  2  0.95  apache  apache(?: software)? licen[cs]e,? ?\(?(?:version|v\.?|ver\.?)? ?2(?:\.0)?\b
apache-2  2  0.85  apache  \bapache[- ]2(?:\.0)?\b
bsd-2-clause  2  0.9  bsd  (?:simplified|2[- ]clause|two[- ]clause|freebsd) bsd(?: licen[cs]e)?
bsd-2-clause  2  0.9  bsd  \bbsd[- ](?:2[- ]clause|simplified)\b
bsd-3-clause  2  0.9  bsd  (?:new|modified|revised|3[- ]clause|three[- ]clause) bsd(?: licen[cs]e)?
bsd-3-clause  2  0.9  bsd  \bbsd[- ](?:3[- ]clause|new|revised)\b
bsd-4-clause  2  0.9  bsd  (?:original|old|4[- ]clause|four[- ]clause) bsd(?: licen[cs]e)?
bsd-4-clause  2  0.9  bsd  \bbsd[- ]4[- ]clause\b
0bsd  2  0.9  bsd  zero[- ]clause bsd(?: licen[cs]e)?
gpl-1  2  0.95  general public  (?:gnu )?general public licen[cs]e,? ?\(?(?:gpl\)?,? ?)?(?:version|v\.?|ver\.?) ?1(?:\.0)?\b(?!\.)
gpl-2  2  0.95  general public  (?<!lesser )(?<!library )(?<!affero )(?:gnu )?general public licen[cs]e,? ?\(?(?:gpl\)?,? ?)?(?:version|v\.?|ver\.?)? ?2(?:\.0)?\b(?!\.)
gpl-3  2  0.95  general public  (?<!lesser )(?<!library )(?<!affero )(?:gnu )?general public licen[cs]e,? ?\(?(?:gpl\)?,? ?)?(?:version|v\.?|ver\.?)? ?3(?:\.0)?\b(?!\.)
gpl-2  2  0.9  gpl  \b(?:gnu )?gpl[, (-]?(?:version|v\.?|ver\.?)? ?2(?:\.0)?(?:\+|-only|-or-later)?(?![\w.]*\d)
gpl-3  2  0.9  gpl  \b(?:gnu )?gpl[, (-]?(?:version|v\.?|ver\.?)? ?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.]*\d)
lgpl-2  2  0.95  general public  gnu (?:lesser|library) general public licen[cs]e,? ?\(?(?:lgpl\)?,? ?)?(?:version|v\.?|ver\.?)? ?2(?:\.0)?\b(?!\.)
lgpl-2.1  2  0.95  general public  (?:gnu )?lesser general public licen[cs]e,? ?\(?(?:lgpl\)?,? ?)?(?:version|v\.?|ver\.?)? ?2\.1\b
lgpl-3  2  0.95  general public  (?:gnu )?lesser general public licen[cs]e,? ?\(?(?:lgpl\)?,? ?)?(?:version|v\.?|ver\.?)? ?3(?:\.0)?\b
lgpl-2.1  2  0.9  lgpl  \blgpl[, (-]?(?:version|v\.?|ver\.?)? ?2\.1(?:\+|-only|-or-later)?
lgpl-3  2  0.9  lgpl  \blgpl[, (-]?(?:version|v\.?|ver\.?)? ?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.]*\d)
agpl-3  2  0.95  affero  (?:gnu )?affero general public licen[cs]e,? ?\(?(?:agpl\)?,? ?)?(?:version|v\.?|ver\.?)? ?3(?:\.0)?\b
agpl-3  2  0.9  agpl  \bagpl[, (-]?(?:version|v\.?|ver\.?)? ?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.]*\d)
gfdl-1.1  2  0.9  free documentation  gnu free documentation licen[cs]e,? ?(?:version|v\.?)? ?1\.1
gfdl-1.2  2  0.9  free documentation  gnu free documentation licen[cs]e,? ?(?:version|v\.?)? ?1\.2
gfdl-1.3  2  0.9  free documentation  gnu free documentation licen[cs]e,? ?(?:version|v\.?)? ?1\.3
mpl-1.0  2  0.9  mozilla  mozilla public licen[cs]e,? ?\(?(?:mpl\)?,? ?)?(?:version|v\.?)? ?1\.0
mpl-1.1  2  0.9  mozilla  mozilla public licen[cs]e,? ?\(?(?:mpl\)?,? ?)?(?:version|v\.?)? ?1\.1
mpl-2.0  2  0.95  mozilla  mozilla public licen[cs]e,? ?\(?(?:mpl\)?,? ?)?(?:version|v\.?)? ?2(?:\.0)?
mpl-1.1  2  0.85  mpl  \bmpl[ -]?v?1\.1\b
mpl-2.0  2  0.85  mpl  \bmpl[ -]?v?2\.0\b
epl-1.0  2  0.9  eclipse  eclipse public licen[cs]e,? ?(?:-|version|v\.?)? ?v?1\.0
epl-2.0  2  0.9  eclipse  eclipse public licen[cs]e,? ?(?:-|version|v\.?)? ?v?2\.0
epl-2.0  2  0.8  epl  \bepl[ -]?v?2\.0\b
cddl-1.0  2  0.9  cddl  \bcddl[ -]?v?1\.0\b
cddl-1.1  2  0.9  cddl  \bcddl[ -]?v?1\.1\b
cddl-1.0  2  0.9  common development  common development and distribution licen[cs]e,? ?(?:\(cddl\),? ?)?(?:version|v\.?)? ?1\.0
cpl-1.0  2  0.9  common public  common public licen[cs]e,? ?(?:version|v\.?)? ?1\.0
eupl-1.1  2  0.9  european union public  european union public licen[cs]e,? ?(?:\(eupl\),? ?)?(?:version|v\.?)? ?1\.1
eupl-1.2  2  0.9  european union public  european union public licen[cs]e,? ?(?:\(eupl\),? ?)?(?:version|v\.?)? ?1\.2
eupl-1.2  2  0.8  eupl  \beupl[ -]?v?1\.2\b
osl-2.1  2  0.9  open software  open software licen[cs]e,? ?(?:version|v\.?)? ?2\.1
osl-3.0  2  0.9  open software  open software licen[cs]e,? ?(?:version|v\.?)? ?3\.0
afl-2.1  2  0.9  academic free  academic free licen[cs]e,? ?(?:version|v\.?)? ?2\.1
afl-3.0  2  0.9  academic free  academic free licen[cs]e,? ?(?:version|v\.?)? ?3\.0
artistic-1.0  2  0.9  artistic  artistic licen[cs]e,? ?(?:version|v\.?)? ?1(?:\.0)?\b
artistic-2.0  2  0.9  artistic  artistic licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
lppl-1.3  2  0.9  latex project  latex project public licen[cs]e,? ?(?:,? either )?(?:version|v\.?)? ?1\.3
bsl-1.0  2  0.9  boost  boost software licen[cs]e,? ?(?:-|version|v\.?)? ?1\.0
busl-1.1  2  0.9  business source  business source licen[cs]e,? ?(?:version|v\.?)? ?1\.1
cc0-1.0  2  0.9  cc0  \bcc0[ -]1\.0\b
cc-by-2.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]2\.0\b
cc-by-2.5  2  0.9  cc by|cc-by  \bcc[ -]by[ -]2\.5\b
cc-by-3.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]3\.0\b
cc-by-4.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]4\.0\b
cc-by-sa-2.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]sa[ -]2\.0\b
cc-by-sa-2.5  2  0.9  cc by|cc-by  \bcc[ -]by[ -]sa[ -]2\.5\b
cc-by-sa-3.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]sa[ -]3\.0\b
cc-by-sa-4.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]sa[ -]4\.0\b
cc-by-nd-3.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nd[ -]3\.0\b
cc-by-nd-4.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nd[ -]4\.0\b
cc-by-nc-2.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]2\.0\b
cc-by-nc-3.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]3\.0\b
cc-by-nc-4.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]4\.0\b
cc-by-nc-sa-3.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]sa[ -]3\.0\b
cc-by-nc-sa-4.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]sa[ -]4\.0\b
cc-by-nc-nd-3.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]nd[ -]3\.0\b
cc-by-nc-nd-4.0  2  0.9  cc by|cc-by  \bcc[ -]by[ -]nc[ -]nd[ -]4\.0\b
odbl-1.0  2  0.9  open database  open database licen[cs]e,? ?(?:\(odbl\),? ?)?(?:version|v\.?)? ?1\.0
ofl-1.1  2  0.9  open font  (?:sil )?open font licen[cs]e,? ?(?:\(ofl\),? ?)?(?:version|v\.?)? ?1\.1
ogl-2.0  2  0.9  open government  open government licen[cs]e,? ?(?:version|v\.?)? ?2\.0
ogl-3.0  2  0.9  open government  open government licen[cs]e,? ?(?:version|v\.?)? ?3\.0
php-3.01  2  0.9  php  \bphp licen[cs]e,? ?(?:version|v\.?)? ?3\.01
ecl-1.0  2  0.9  educational community  educational community licen[cs]e,? ?(?:version|v\.?)? ?1\.0
ecl-2.0  2  0.9  educational community  educational community licen[cs]e,? ?(?:version|v\.?)? ?2\.0
sspl-1  2  0.9  server side public  server side public licen[cs]e,? ?(?:version|v\.?)? ?1\b
elastic-2.0  2  0.9  elastic  elastic licen[cs]e,? ?(?:version|v\.?)? ?2\.0
upl-1.0  2  0.9  universal permissive  universal permissive licen[cs]e,? ?(?:version|v\.?)? ?1\.0

# addresses
mit  2  0.9  opensource.org  opensource\.org/licenses?/mit\b
bsd-2-clause  2  0.9  opensource.org  opensource\.org/licenses?/bsd-2-clause
bsd-3-clause  2  0.9  opensource.org  opensource\.org/licenses?/bsd-3-clause
bsd  2  0.8  opensource.org  opensource\.org/licenses?/bsd-license
apache-2  2  0.9  opensource.org  opensource\.org/licenses?/apache-2\.0
gpl-2  2  0.9  opensource.org  opensource\.org/licenses?/gpl-2\.0
gpl-3  2  0.9  opensource.org  opensource\.org/licenses?/gpl-3\.0
isc  2  0.9  opensource.org  opensource\.org/licenses?/isc
zlib  2  0.9  opensource.org  opensource\.org/licenses?/zlib
ms-pl  2  0.9  opensource.org  opensource\.org/licenses?/ms-pl
apache-2  2  0.9  apache.org  apache\.org/licenses/license-2\.0
apache-1.1  2  0.9  apache.org  apache\.org/licenses/license-1\.1
apache  1  0.8  apache.org  apache\.org/licenses/?(?!license)
gpl-2  2  0.9  gnu.org  gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3  2  0.9  gnu.org  gnu\.org/licenses/gpl-3\.0
gpl  1  0.8  gnu.org  gnu\.org/(?:licenses|copyleft)/gpl(?!-)
lgpl-2.1  2  0.9  gnu.org  gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3  2  0.9  gnu.org  gnu\.org/licenses/lgpl-3\.0
lgpl  1  0.8  gnu.org  gnu\.org/(?:licenses|copyleft)/lgpl(?!-)
agpl-3  2  0.9  gnu.org  gnu\.org/licenses/agpl-3\.0
gfdl  1  0.8  gnu.org  \bgnu\.org/(?:licenses|copyleft)/fdl
gpl  0  0.5  gnu.org  gnu\.org/licenses/?(?![a-z])
mpl-1.1  2  0.9  mozilla.org  mozilla\.org/mpl/(?:mpl-)?1\.1
mpl-2.0  2  0.9  mozilla.org  mozilla\.org/(?:en-us/)?mpl/2\.0
mpl  1  0.8  mozilla.org  mozilla\.org/(?:en-us/)?mpl/?(?![\w/])
epl-1.0  2  0.9  eclipse.org  eclipse\.org/legal/epl-v10
epl-2.0  2  0.9  eclipse.org  eclipse\.org/legal/epl-(?:v20|2\.0)
cc0-1.0  2  0.95  creativecommons.org  creativecommons\.org/publicdomain/zero/1\.0
public-domain  2  0.9  creativecommons.org  creativecommons\.org/(?:publicdomain/mark|licenses/publicdomain)
cc-by-1.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by/1\.0
cc-by-2.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by/2\.0
cc-by-2.5  2  0.95  creativecommons.org  creativecommons\.org/licenses/by/2\.5
cc-by-3.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by/3\.0
cc-by-4.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by/4\.0
cc-by-sa-2.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-2.5  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-3.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-sa/4\.0
cc-by-nd-3.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-2.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc/2\.0
cc-by-nc-3.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-2.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc-sa/2\.0
cc-by-nc-sa-3.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-3.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0  2  0.95  creativecommons.org  creativecommons\.org/licenses/by-nc-nd/4\.0
odbl  2  0.9  opendatacommons.org  opendatacommons\.org/licenses/odbl
odc-by  2  0.9  opendatacommons.org  opendatacommons\.org/licenses/by\b
pddl  2  0.9  opendatacommons.org  opendatacommons\.org/licenses/pddl
unlicense  2  0.9  unlicense.org  \bunlicense\.org
ofl-1.1  2  0.9  scripts.sil.org  scripts\.sil\.org/ofl
bsl-1.0  2  0.9  boost.org  boost\.org/license_1_0
artistic-2.0  2  0.9  perlfoundation.org  perlfoundation\.org/artistic_license_2_0
wtfpl  2  0.9  wtfpl.net  wtfpl\.net
sspl-1  2  0.9  mongodb.com  mongodb\.com/licensing/server-side-public-license

# bare names
mit  1  0.8  mit license|mit licence  \b(?:the )?mit licen[cs]e\b
mit  1  0.8  mit-licensed|mit licensed  \bmit[- ]licensed\b
mit  1  0.8  expat  \bexpat licen[cs]e\b
mit-0  1  0.85  mit no attribution  \bmit no attribution\b
x11  1  0.8  x11 licen  \b(?:mit/)?x11 licen[cs]e\b
apache  1  0.8  apache licen|apache software licen  \bapache(?: software)? licen[cs]e\b
apache  1  0.7  apache-licensed|apache licensed  \bapache[- ]licensed\b
bsd  1  0.75  bsd  \bbsd(?:[- ](?:style|type|like))? licen[cs]e
bsd  1  0.7  bsd  \bbsd[- ]licensed\b
gpl  1  0.85  general public licen  (?<!lesser )(?<!library )(?<!affero )\b(?:gnu )?general public licen[cs]e\b
gpl  1  0.75  gpl  \b(?:gnu )?gpl\b(?:[- ]licensed)?
lgpl  1  0.85  general public licen  \b(?:gnu )?(?:lesser|library) general public licen[cs]e\b
lgpl  1  0.75  lgpl  \b(?:gnu )?lgpl\b
agpl  1  0.85  affero  \b(?:gnu )?affero general public licen[cs]e\b
agpl  1  0.75  agpl  \b(?:gnu )?agpl\b
gfdl  1  0.8  free documentation licen  \b(?:gnu )?free documentation licen[cs]e\b
gfdl  1  0.75  gfdl  \bgfdl\b
mpl  1  0.8  mozilla public licen  \bmozilla public licen[cs]e\b
epl  1  0.8  eclipse public licen  \beclipse public licen[cs]e\b
edl  1  0.8  eclipse distribution  \beclipse distribution licen[cs]e\b
cddl  1  0.8  common development and distribution  \bcommon development and distribution licen[cs]e\b
cddl  1  0.75  cddl  \bcddl\b
cpl  1  0.8  common public licen  \bcommon public licen[cs]e\b
cpal  1  0.8  common public attribution  \bcommon public attribution licen[cs]e\b
eupl  1  0.8  european union public  \beuropean union public licen[cs]e\b
eupl  1  0.75  eupl  \beupl\b
cecill  1  0.8  cecill  \bcecill(?:-[abc])?\b
osl  1  0.8  open software licen  \bopen software licen[cs]e\b
afl  1  0.8  academic free licen  \bacademic free licen[cs]e\b
artistic  1  0.8  artistic licen  \bartistic licen[cs]e\b
lppl  1  0.8  latex project public  \blatex project public licen[cs]e\b
lppl  1  0.75  lppl  \blppl\b
ms-pl  1  0.85  microsoft public licen  \bmicrosoft public licen[cs]e\b
ms-rl  1  0.85  microsoft reciprocal licen  \bmicrosoft reciprocal licen[cs]e\b
isc  1  0.8  isc licen  \bisc licen[cs]e\b
zlib  1  0.8  zlib  \bzlib(?:/libpng)? licen[cs]e\b
libpng  1  0.8  libpng licen  \blibpng licen[cs]e\b
bsl  1  0.8  boost software licen  \bboost software licen[cs]e\b
busl  1  0.8  business source licen  \bbusiness source licen[cs]e\b
unlicense  1  0.8  the unlicense  \bthe unlicense\b
wtfpl  1  0.8  wtfpl  \bwtfpl\b
beerware  1  0.8  beerware|beer-ware  \bbeer-?ware licen[cs]e\b
cc0  1  0.8  cc0  \bcc0\b
cc-by  1  0.8  creative commons attribution  \bcreative commons attribution(?![- ](?:non|share|no))(?: licen[cs]e)?\b
cc-by-sa  1  0.8  creative commons attribution  \bcreative commons attribution[- ]share[- ]?alike\b
cc-by-nd  1  0.8  creative commons attribution  \bcreative commons attribution[- ]no[- ]?deriv[a-z]*\b
cc-by-nc  1  0.8  creative commons attribution  \bcreative commons attribution[- ]non[- ]?commercial\b(?![- ](?:share|no))
cc-by-nc-sa  1  0.8  creative commons attribution  \bcreative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike\b
cc-by-nc-nd  1  0.8  creative commons attribution  \bcreative commons attribution[- ]non[- ]?commercial[- ]no[- ]?deriv[a-z]*\b
cc-by  1  0.75  cc by|cc-by  \bcc[ -]by\b(?![ -](?:nc|sa|nd))
cc-by-sa  1  0.75  cc by|cc-by  \bcc[ -]by[ -]sa\b
cc-by-nd  1  0.75  cc by|cc-by  \bcc[ -]by[ -]nd\b
cc-by-nc  1  0.75  cc by|cc-by  \bcc[ -]by[ -]nc\b(?![ -](?:sa|nd))
cc-by-nc-sa  1  0.75  cc by|cc-by  \bcc[ -]by[ -]nc[ -]sa\b
cc-by-nc-nd  1  0.75  cc by|cc-by  \bcc[ -]by[ -]nc[ -]nd\b
creative-commons  0  0.5  creative commons  \bcreative commons(?: licen[cs]e)?\b
odbl  1  0.8  open database licen  \bopen database licen[cs]e\b
odbl  1  0.75  odbl  \bodbl\b
odc-by  1  0.8  open data commons attribution  \bopen data commons attribution\b
pddl  1  0.8  public domain dedication and  \bpublic domain dedication and licen[cs]e\b
cdla-permissive  1  0.8  community data licen  \bcommunity data licen[cs]e agreement[ –-]+permissive\b
cdla-sharing  1  0.8  community data licen  \bcommunity data licen[cs]e agreement[ –-]+sharing\b
ofl  1  0.8  open font licen  \b(?:sil )?open font licen[cs]e\b
ogl  1  0.8  open government licen  \bopen government licen[cs]e\b
openrail  1  0.8  openrail|open rail  \bopen ?rail(?:-m|\+\+)?\b
psf  1  0.8  python software foundation licen  \bpython software foundation licen[cs]e\b
php  1  0.8  php licen  \bphp licen[cs]e\b
ruby  1  0.75  ruby licen  \bruby licen[cs]e\b
w3c  1  0.8  w3c software  \bw3c software (?:notice and )?licen[cs]e\b
postgresql  1  0.8  postgresql licen  \bpostgresql licen[cs]e\b
openssl  1  0.8  openssl licen  \bopenssl licen[cs]e\b
vim  1  0.8  vim licen  \bvim licen[cs]e\b
ncsa  1  0.8  ncsa  \b(?:university of illinois/)?ncsa (?:open source )?licen[cs]e\b
ecl  1  0.8  educational community licen  \beducational community licen[cs]e\b
sspl  1  0.8  server side public licen  \bserver side public licen[cs]e\b
elastic  1  0.8  elastic licen  \belastic licen[cs]e\b
upl  1  0.8  universal permissive licen  \buniversal permissive licen[cs]e\b
mulan  1  0.8  mulan  \bmulan (?:psl|permissive software licen[cs]e|public licen[cs]e)\b
ibm-public  1  0.8  ibm public licen  \bibm public licen[cs]e\b
apsl  1  0.8  apple public source  \bapple public source licen[cs]e\b
npl  1  0.8  netscape public licen  \bnetscape public licen[cs]e\b
qpl  1  0.8  q public licen  \bq public licen[cs]e\b
sleepycat  1  0.8  sleepycat licen  \bsleepycat licen[cs]e\b
public-domain  1  0.8  public domain  \b(?:in|into|to) the public domain\b
public-domain  1  0.8  public domain  \bpublic domain dedication\b(?! and licen)

# hints
proprietary  0  0.3  reserved  \ball rights (?:are )?reserved\b
proprietary  0  0.6  proprietary and confidential|confidential and proprietary  \b(?:proprietary and confidential|confidential and proprietary)\b
proprietary  0  0.5  unauthorized  \bunauthorized (?:copying|reproduction|distribution|use) (?:of this|or|is)\b
proprietary  0  0.5  end user licen|end-user licen  \bend[- ]user licen[cs]e agreement\b
proprietary  0  0.4  written permission  \bwithout (?:the )?(?:express |prior )*(?:prior )?written permission of\b
copyright  0  0.3  copyright  \bcopyright (?:\(c\) |© |&copy; )?(?:19|20)\d\d
unknown-license  0  0.3  licen  \blicen[cs]ed under\b
unknown-license  0  0.3  license file|licence file  \bsee (?:the )?(?:accompanying )?licen[cs]e file\b
unknown-license  0  0.3  terms and conditions  \bsubject to the (?:following )?terms and conditions\b
"""


def table() -> list[Rule]:
    """The rules in order of priority, highest first; within one as written."""
    found = []
    for line in TABLE.splitlines():
        if line and line[0] != "#":
            label, priority, confidence, keywords, pattern = re.split(r" {2,}", line, maxsplit=4)
            found.append(Rule(label, int(priority), float(confidence), tuple(keywords.split("|")), pattern))
    return sorted(found, key=lambda r: -r.priority)
