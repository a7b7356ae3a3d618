"""The signature rules of the license scan, one a line, in order of priority.

A line is ``label | keyword | score | pattern``. The pattern runs over words parted by single spaces (small letters,
signs dropped, so "GPL-3.0+" reads "gpl 3 0"); ``~`` stands for license or licence, and ``!`` at the end refuses a place
that a version follows, which a line with that version takes. Of overlapping detections the one of the earlier
line stands when it holds the other. More telling forms come first: identifiers, full grants, versions with "or later",
versions, names without one.
"""

IDENTIFIERS = r"""
gpl-2-or-later | spdx | 0.99 | spdx ~ identifier gpl 2 0 or later
gpl-3-or-later | spdx | 0.99 | spdx ~ identifier gpl 3 0 or later
lgpl-2-or-later | spdx | 0.99 | spdx ~ identifier lgpl 2 0 or later
lgpl-2.1-or-later | spdx | 0.99 | spdx ~ identifier lgpl 2 1 or later
lgpl-3-or-later | spdx | 0.99 | spdx ~ identifier lgpl 3 0 or later
agpl-3-or-later | spdx | 0.99 | spdx ~ identifier agpl 3 0 or later
gfdl-1.3-or-later | spdx | 0.99 | spdx ~ identifier gfdl 1 3 or later
gpl-2 | spdx | 0.98 | spdx ~ identifier gpl 2 0(?: only)?
gpl-3 | spdx | 0.98 | spdx ~ identifier gpl 3 0(?: only)?
gpl-1 | spdx | 0.98 | spdx ~ identifier gpl 1 0(?: only)?
lgpl-2 | spdx | 0.98 | spdx ~ identifier lgpl 2 0(?: only)?
lgpl-2.1 | spdx | 0.98 | spdx ~ identifier lgpl 2 1(?: only)?
lgpl-3 | spdx | 0.98 | spdx ~ identifier lgpl 3 0(?: only)?
agpl-3 | spdx | 0.98 | spdx ~ identifier agpl 3 0(?: only)?
agpl-1 | spdx | 0.98 | spdx ~ identifier agpl 1 0(?: only)?
gfdl-1.3 | spdx | 0.98 | spdx ~ identifier gfdl 1 3(?: only)?
mit-0 | spdx | 0.98 | spdx ~ identifier mit 0
mit-modern | spdx | 0.98 | spdx ~ identifier mit modern variant
mit | spdx | 0.98 | spdx ~ identifier (?:mit|expat|x11)
apache-1 | spdx | 0.98 | spdx ~ identifier apache 1 0
apache-1.1 | spdx | 0.98 | spdx ~ identifier apache 1 1
apache-2 | spdx | 0.98 | spdx ~ identifier apache 2 0
bsd-1-clause | spdx | 0.98 | spdx ~ identifier bsd 1 clause
bsd-2-clause-patent | spdx | 0.98 | spdx ~ identifier bsd 2 clause patent
bsd-3-clause-clear | spdx | 0.98 | spdx ~ identifier bsd 3 clause clear
bsd-2-clause | spdx | 0.98 | spdx ~ identifier bsd 2 clause
bsd-3-clause | spdx | 0.98 | spdx ~ identifier bsd 3 clause
bsd-4-clause | spdx | 0.98 | spdx ~ identifier bsd 4 clause
0bsd | spdx | 0.98 | spdx ~ identifier 0bsd
isc | spdx | 0.98 | spdx ~ identifier isc
zlib | spdx | 0.98 | spdx ~ identifier zlib
libpng-2 | spdx | 0.98 | spdx ~ identifier libpng 2 0
boost-1 | spdx | 0.98 | spdx ~ identifier bsl 1 0
busl-1.1 | spdx | 0.98 | spdx ~ identifier busl 1 1
mpl-1.1 | spdx | 0.98 | spdx ~ identifier mpl 1 1
mpl-2 | spdx | 0.98 | spdx ~ identifier mpl 2 0
epl-1 | spdx | 0.98 | spdx ~ identifier epl 1 0
epl-2 | spdx | 0.98 | spdx ~ identifier epl 2 0
cddl-1 | spdx | 0.98 | spdx ~ identifier cddl 1 0
cddl-1.1 | spdx | 0.98 | spdx ~ identifier cddl 1 1
cpl-1 | spdx | 0.98 | spdx ~ identifier cpl 1 0
eupl-1.1 | spdx | 0.98 | spdx ~ identifier eupl 1 1
eupl-1.2 | spdx | 0.98 | spdx ~ identifier eupl 1 2
artistic-1 | spdx | 0.98 | spdx ~ identifier artistic 1 0
artistic-2 | spdx | 0.98 | spdx ~ identifier artistic 2 0
ofl-1.1 | spdx | 0.98 | spdx ~ identifier ofl 1 1
unlicense | spdx | 0.98 | spdx ~ identifier unlicense
wtfpl | spdx | 0.98 | spdx ~ identifier wtfpl
cc0-1 | spdx | 0.98 | spdx ~ identifier cc0 1 0
cc-by-nc-sa | spdx | 0.98 | spdx ~ identifier cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | spdx | 0.98 | spdx ~ identifier cc by nc nd(?: [1-4] [05])?
cc-by-nc | spdx | 0.98 | spdx ~ identifier cc by nc(?: [1-4] [05])?
cc-by-sa | spdx | 0.98 | spdx ~ identifier cc by sa(?: [1-4] [05])?
cc-by-nd | spdx | 0.98 | spdx ~ identifier cc by nd(?: [1-4] [05])?
cc-by | spdx | 0.98 | spdx ~ identifier cc by(?: [1-4] [05])?
python-2 | spdx | 0.98 | spdx ~ identifier (?:psf|python) 2 0
postgresql | spdx | 0.98 | spdx ~ identifier postgresql
openssl | spdx | 0.98 | spdx ~ identifier openssl
curl | spdx | 0.98 | spdx ~ identifier curl
ncsa | spdx | 0.98 | spdx ~ identifier ncsa
ms-pl | spdx | 0.98 | spdx ~ identifier ms pl
ms-rl | spdx | 0.98 | spdx ~ identifier ms rl
mulanpsl-2 | spdx | 0.98 | spdx ~ identifier mulanpsl 2 0
osl-3 | spdx | 0.98 | spdx ~ identifier osl 3 0
upl-1 | spdx | 0.98 | spdx ~ identifier upl 1 0
vim | spdx | 0.98 | spdx ~ identifier vim
zpl-2.1 | spdx | 0.98 | spdx ~ identifier zpl 2 1
odbl-1 | spdx | 0.98 | spdx ~ identifier odbl 1 0
sspl-1 | spdx | 0.98 | spdx ~ identifier sspl 1 0
none | spdx | 0.9 | spdx ~ identifier (?:none|noassertion)
"""

#: Sentences of the licenses' own texts and of the notices that they ask for.
NOTICES = r"""
mit | permission is hereby granted | 0.97 | permission is hereby granted free of charge to any person obtaining a copy
mit | without restriction | 0.9 | to deal in the software without restriction including without limitation
mit | substantial portions | 0.85 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | permission to use copy modify | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | permission to use copy modify | 0.9 | permission to use copy modify and or distribute this software for any purpose
bsd-4-clause | advertising materials | 0.93 | all advertising materials mentioning features or use of this software must display
bsd-3-clause | neither the name | 0.93 | neither the name of .{0,80}? nor the names of its contributors
bsd-3-clause | neither the name | 0.85 | neither the name of .{0,80}? may be used to endorse or promote
bsd | redistribution and use | 0.9 | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions | 0.75 | redistributions of source code must retain the above copyright notice
bsd | redistributions | 0.75 | redistributions in binary form must reproduce the above copyright notice
bsd | governed by a bsd style | 0.9 | use of this (?:source code|software) is governed by a bsd style ~
apache-2 | licensed under the apache | 0.98 | licensed under the apache ~ version 2 0 the ~ you may not use this file except in compliance with the ~
apache-2 | except in compliance | 0.85 | you may not use this file except in compliance with the ~
apache-2 | as is basis | 0.7 | distributed on an as is basis without warranties or conditions of any kind
apache-2 | apache org licenses | 0.9 | www apache org licenses ~ 2 0
gpl-2-or-later | either version 2 | 0.95 | gnu general public ~ as published by the free software foundation either version 2 of the ~ or at your option any later version
gpl-3-or-later | either version 3 | 0.95 | gnu general public ~ as published by the free software foundation either version 3 of the ~ or at your option any later version
lgpl-2.1-or-later | either version 2 1 | 0.95 | gnu lesser general public ~ as published by the free software foundation either version 2 1 of the ~ or at your option any later version
lgpl-3-or-later | either version 3 | 0.95 | gnu lesser general public ~ as published by the free software foundation either version 3 of the ~ or at your option any later version
agpl-3-or-later | either version 3 | 0.95 | gnu affero general public ~ as published by the free software foundation either version 3 of the ~ or at your option any later version
gpl-2 | version 2 as published | 0.93 | (?:gnu general public ~ )?version 2 as published by the free software foundation
gpl-3 | version 3 as published | 0.93 | (?:gnu general public ~ )?version 3 as published by the free software foundation
gpl-2-or-later | either version 2 | 0.9 | either version 2 of the ~ or at your option any later version
gpl-3-or-later | either version 3 | 0.9 | either version 3 of the ~ or at your option any later version
gpl | free software foundation | 0.7 | this program is free software you can redistribute it and or modify it
lgpl | this library is free software | 0.75 | this library is free software you can redistribute it and or modify it
agpl-3 | interact with it remotely | 0.85 | all users interacting with it remotely through a computer network
mpl-2 | mozilla public | 0.97 | this source code form is subject to the terms of the mozilla public ~ v 2 0
mpl-1.1 | mozilla public | 0.95 | the contents of this file are subject to the mozilla public ~ version 1 1
epl-2 | eclipse public | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public ~ (?:v ?)?2 0
epl-1 | eclipse public | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public ~ v ?1 0
cddl-1 | common development | 0.93 | the contents of this file are subject to the terms of the common development and distribution ~
zlib | altered source versions | 0.9 | altered source versions must be plainly marked as such
zlib | origin of this software | 0.9 | the origin of this software must not be misrepresented
boost-1 | boost software | 0.95 | distributed under the boost software ~ version 1 0
boost-1 | boost software | 0.95 | boost software ~ version 1 0 august 17th 2003
unlicense | unencumbered software | 0.95 | this is free and unencumbered software released into the public domain
wtfpl | what the fuck | 0.9 | do what the fuck you want to(?: public ~)?
ofl-1.1 | sil open font | 0.95 | this font software is licensed under the sil open font ~ version 1 1
artistic-2 | artistic | 0.9 | artistic ~ 2 0 copyright
python-2 | psf | 0.9 | psf ~ agreement for python
postgresql | postgresql | 0.9 | postgresql database management system formerly known as postgres
openssl | openssl | 0.9 | this product includes software developed by the openssl project
ncsa | university of illinois | 0.9 | university of illinois ncsa open source ~
gfdl-1.3-or-later | free documentation | 0.93 | gnu free documentation ~ version 1 3 or any later version published
gfdl | free documentation | 0.85 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation ~
cc0-1 | waived all copyright | 0.9 | waived all copyright and related or neighboring rights
cc-by | to view a copy | 0.85 | to view a copy of this ~ visit (?:http |https )?creativecommons org licenses by [1-4] 0
cc-by-sa | to view a copy | 0.85 | to view a copy of this ~ visit (?:http |https )?creativecommons org licenses by sa [1-4] 0
cc-by-nc | to view a copy | 0.85 | to view a copy of this ~ visit (?:http |https )?creativecommons org licenses by nc [1-4] 0
public-domain | public domain | 0.85 | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | public domain | 0.8 | (?:is|are) in the public domain
proprietary | confidential | 0.85 | proprietary and confidential
proprietary | unauthorized copying | 0.85 | unauthorized copying of this (?:file|document|work|software)
proprietary | without the prior written | 0.8 | (?:may not|must not|no part may) be (?:reproduced|copied|distributed|used).{0,80}? without the prior written (?:permission|consent)
all-rights-reserved | all rights reserved | 0.7 | all rights reserved
"""

#: Addresses of license texts.
ADDRESSES = r"""
cc-by-nc-sa | creativecommons | 0.9 | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | creativecommons | 0.9 | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc | creativecommons | 0.9 | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-sa | creativecommons | 0.9 | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | creativecommons | 0.9 | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by | creativecommons | 0.9 | creativecommons org licenses by(?: [1-4] [05])?
cc0-1 | creativecommons | 0.9 | creativecommons org publicdomain zero 1 0
mit | opensource org | 0.9 | opensource org licenses mit(?: ~)?
apache-2 | opensource org | 0.9 | opensource org licenses apache 2 0
bsd-2-clause | opensource org | 0.9 | opensource org licenses bsd 2 clause
bsd-3-clause | opensource org | 0.9 | opensource org licenses bsd 3 clause
isc | opensource org | 0.9 | opensource org licenses isc(?: ~)?
gpl-2 | gnu org | 0.9 | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3 | gnu org | 0.9 | gnu org licenses gpl 3 0
lgpl-2.1 | gnu org | 0.9 | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3 | gnu org | 0.9 | gnu org licenses lgpl 3 0
agpl-3 | gnu org | 0.9 | gnu org licenses agpl 3 0
gpl | gnu org | 0.8 | gnu org licenses gpl
lgpl | gnu org | 0.8 | gnu org licenses lgpl
gfdl | gnu org | 0.8 | gnu org licenses fdl
mpl-2 | mozilla org | 0.9 | mozilla org mpl 2 0
epl-2 | eclipse org | 0.9 | eclipse org legal epl (?:v20|2 0)
boost-1 | boost org | 0.9 | boost org license 1 0
ofl-1.1 | sil org | 0.9 | scripts sil org ofl
unlicense | unlicense org | 0.9 | unlicense org
"""

#: Versions that allow later ones, versions, and the long names.
VERSIONS = r"""
gpl-2-or-later | gpl | 0.92 | (?:gnu )?gpl(?: version)? ?v? ?2(?: 0)? or(?: \(?at your option\)?)?(?: any)? (?:later|newer)(?: version)?
gpl-3-or-later | gpl | 0.92 | (?:gnu )?gpl(?: version)? ?v? ?3(?: 0)? or(?: any)? (?:later|newer)(?: version)?
lgpl-2.1-or-later | lgpl | 0.92 | (?:gnu )?lgpl(?: version)? ?v? ?2 1 or(?: any)? (?:later|newer)(?: version)?
lgpl-2-or-later | lgpl | 0.92 | (?:gnu )?lgpl(?: version)? ?v? ?2(?: 0)? or(?: any)? (?:later|newer)(?: version)?
lgpl-3-or-later | lgpl | 0.92 | (?:gnu )?lgpl(?: version)? ?v? ?3(?: 0)? or(?: any)? (?:later|newer)(?: version)?
agpl-3-or-later | agpl | 0.92 | (?:gnu )?agpl(?: version)? ?v? ?3(?: 0)? or(?: any)? (?:later|newer)(?: version)?
gpl-2-or-later | general public | 0.93 | (?:gnu )?general public ~(?: gpl)? (?:version |v ?)?2(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
gpl-3-or-later | general public | 0.93 | (?:gnu )?general public ~(?: gpl)? (?:version |v ?)?3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
lgpl-2.1-or-later | lesser general public | 0.94 | (?:gnu )?lesser general public ~(?: lgpl)? (?:version |v ?)?2 1 or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
lgpl-3-or-later | lesser general public | 0.94 | (?:gnu )?lesser general public ~(?: lgpl)? (?:version |v ?)?3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
agpl-3-or-later | affero general public | 0.94 | (?:gnu )?affero general public ~(?: agpl)? (?:version |v ?)?3(?: 0)? or(?: at your option)?(?: any)? (?:later|newer)(?: version)?
lgpl-2.1 | lesser general public | 0.92 | (?:gnu )?lesser general public(?: ~)?(?: lgpl)? ?(?:version |v ?)?2 1(?: only)?
lgpl-3 | lesser general public | 0.92 | (?:gnu )?lesser general public(?: ~)?(?: lgpl)? ?(?:version |v ?)?3(?: 0)?(?: only)?
lgpl-2 | library general public | 0.92 | (?:gnu )?library general public(?: ~)?(?: lgpl)? ?(?:version |v ?)?2(?: 0)?(?: only)?
agpl-3 | affero general public | 0.92 | (?:gnu )?affero general public(?: ~)?(?: agpl)? ?(?:version |v ?)?3(?: 0)?(?: only)?
gpl-1 | general public | 0.9 | (?:gnu )?general public(?: ~)?(?: gpl)? ?(?:version |v ?)1(?: 0)?
gpl-2 | general public | 0.9 | (?:gnu )?general public(?: ~)?(?: gpl)? ?(?:version |v ?)?2(?: 0)?(?: only)?
gpl-3 | general public | 0.9 | (?:gnu )?general public(?: ~)?(?: gpl)? ?(?:version |v ?)?3(?: 0)?(?: only)?
lgpl-2.1 | lgpl | 0.88 | (?:gnu )?lgpl(?: version)? ?v? ?2 1(?: only)?
lgpl-2 | lgpl | 0.88 | (?:gnu )?lgpl(?: version)? ?v? ?2(?: 0)?(?: only)?
lgpl-3 | lgpl | 0.88 | (?:gnu )?lgpl(?: version)? ?v? ?3(?: 0)?(?: only)?
agpl-3 | agpl | 0.88 | (?:gnu )?agpl(?: version)? ?v? ?3(?: 0)?(?: only)?
gpl-1 | gpl | 0.85 | (?:gnu )?gpl(?: version)? ?v? ?1(?: 0)?
gpl-2 | gpl | 0.88 | (?:gnu )?gpl(?: version)? ?v? ?2(?: 0)?(?: only)?
gpl-3 | gpl | 0.88 | (?:gnu )?gpl(?: version)? ?v? ?3(?: 0)?(?: only)?
gfdl-1.3 | free documentation | 0.9 | (?:gnu )?free documentation ~ (?:version |v ?)?1 3
gfdl-1.2 | free documentation | 0.9 | (?:gnu )?free documentation ~ (?:version |v ?)?1 2
apache-2 | apache | 0.93 | licensed under (?:the )?apache(?: software)? ~ (?:version |v ?)?2(?: 0)?
apache-2 | apache | 0.9 | (?:the )?apache(?: software)? ~ (?:version |v ?)?2(?: 0)?
apache-2 | apache | 0.9 | apache (?:version |v ?)?2(?: 0)?(?: ~)?
apache-1.1 | apache | 0.9 | apache(?: software)? ~ (?:version |v ?)?1 1
apache-1.1 | apache | 0.88 | apache (?:version |v ?)?1 1(?: ~)?
apache-1 | apache | 0.88 | apache(?: software)? ~ (?:version |v ?)?1 0
mpl-1.1 | mozilla public | 0.9 | mozilla public ~ (?:version |v ?)?1 1
mpl-2 | mozilla public | 0.9 | mozilla public ~ (?:version |v ?)?2(?: 0)?
mpl-1.1 | mpl | 0.85 | mpl(?: version)? ?v? ?1 1
mpl-2 | mpl | 0.85 | mpl(?: version)? ?v? ?2(?: 0)?
epl-1 | eclipse public | 0.9 | eclipse public ~ (?:version |v ?)?1(?: 0)?
epl-2 | eclipse public | 0.9 | eclipse public ~ (?:version |v ?)?2(?: 0)?
epl-1 | epl | 0.85 | epl(?: version)? ?v? ?1(?: 0)?
epl-2 | epl | 0.85 | epl(?: version)? ?v? ?2(?: 0)?
cddl-1.1 | cddl | 0.85 | cddl(?: version)? ?v? ?1 1
cddl-1 | cddl | 0.85 | cddl(?: version)? ?v? ?1(?: 0)?
cddl-1 | common development | 0.88 | common development and distribution ~(?: cddl)?(?: version)?(?: 1 0)?
cpl-1 | common public | 0.88 | common public ~(?: version)?(?: 1 0)?
eupl-1.1 | european union public | 0.9 | european union public ~ (?:version |v ?)?1 1
eupl-1.2 | european union public | 0.9 | european union public ~ (?:version |v ?)?1 2
eupl-1.1 | eupl | 0.85 | eupl(?: version)? ?v? ?1 1
eupl-1.2 | eupl | 0.85 | eupl(?: version)? ?v? ?1 2
artistic-1 | artistic | 0.88 | artistic ~ (?:version |v ?)?1(?: 0)?
artistic-2 | artistic | 0.88 | artistic ~ (?:version |v ?)?2(?: 0)?
ofl-1.1 | open font | 0.9 | (?:sil )?open font ~ (?:version |v ?)?1 1
ofl-1.1 | ofl | 0.85 | ofl(?: version)? ?v? ?1 1
boost-1 | boost software | 0.9 | boost software ~ (?:version |v ?)?1(?: 0)?
boost-1 | bsl | 0.75 | bsl 1 0
busl-1.1 | business source | 0.9 | business source ~ (?:version |v ?)?1 1
sspl-1 | server side public | 0.9 | server side public ~(?: version| v)? ?1?
osl-3 | open software | 0.88 | open software ~ (?:version |v ?)?3(?: 0)?
afl-3 | academic free | 0.88 | academic free ~ (?:version |v ?)?3(?: 0)?
upl-1 | universal permissive | 0.88 | universal permissive ~(?: version| v)?(?: 1 0)?
zpl-2.1 | zope public | 0.88 | zope public ~ (?:version |v ?)?2 1
ms-pl | microsoft public | 0.88 | microsoft public ~
ms-rl | microsoft reciprocal | 0.88 | microsoft reciprocal ~
odbl-1 | open database | 0.88 | open database ~(?: odbl)?(?: version| v)?(?: 1 0)?
odc-by-1 | open data commons | 0.88 | open data commons attribution ~
mulanpsl-2 | mulan | 0.88 | mulan (?:permissive software ~|psl)(?: version)? ?v?2
"""

#: Creative Commons by name and by tag, longest set of terms first.
COMMONS = r"""
cc-by-nc-sa | creative commons | 0.93 | creative commons(?: ~)? (?:attribution|by) (?:non ?commercial|nc) (?:share ?alike|sa)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: ~)?
cc-by-nc-nd | creative commons | 0.93 | creative commons(?: ~)? (?:attribution|by) (?:non ?commercial|nc) (?:no ?deriv\w*|nd)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: ~)?
cc-by-nc | creative commons | 0.92 | creative commons(?: ~)? (?:attribution|by) (?:non ?commercial|nc)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: ~)?
cc-by-sa | creative commons | 0.92 | creative commons(?: ~)? (?:attribution|by) (?:share ?alike|sa)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: ~)?
cc-by-nd | creative commons | 0.92 | creative commons(?: ~)? (?:attribution|by) (?:no ?deriv\w*|nd)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: ~)?
cc-by | creative commons | 0.9 | creative commons(?: ~)? (?:attribution|by)(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: ~)?
cc0-1 | creative commons | 0.92 | creative commons(?: ~)? (?:zero|cc0)(?: 1 0)?(?: universal)?
cc0-1 | cc0 | 0.88 | cc0(?: 1 0)?(?: universal)?
cc0-1 | cc zero | 0.85 | cc zero
cc-by-nc-sa | cc by nc sa | 0.85 | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | cc by nc nd | 0.85 | cc by nc nd(?: [1-4] [05])?
cc-by-nc | cc by nc | 0.85 | cc by nc(?: [1-4] [05])?
cc-by-sa | cc by sa | 0.85 | cc by sa(?: [1-4] [05])?
cc-by-nd | cc by nd | 0.85 | cc by nd(?: [1-4] [05])?
cc-by | cc by | 0.75 | cc by [1-4] [05]
cc-by | cc by | 0.6 | (?:licensed|released|available) under (?:an? |the )?cc by
"""

#: Statements that name a license without a version, and headings.
STATEMENTS = r"""
mit-0 | mit | 0.9 | mit no attribution(?: ~)?
mit | mit | 0.93 | (?:licensed|released|distributed|available|provided|published|offered) under (?:the )?(?:terms of the )?(?:mit|expat|x11 mit|mit x11)(?: ~)?
mit | mit | 0.9 | under (?:the )?terms of the (?:mit|expat)(?: ~)?
mit | mit | 0.88 | (?:mit|expat)(?: style| open source)? ~
mit | mit | 0.85 | ~ (?:is )?mit
mit | x11 | 0.75 | x11 ~
apache | apache | 0.88 | (?:licensed|released|distributed|available|provided|published|offered) under (?:the )?(?:terms of the )?apache(?: software)?(?: ~)?+!
apache | apache | 0.8 | apache(?: software)? ~!
apache-2 | asl | 0.7 | asl 2 0
bsd-2-clause | bsd | 0.9 | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: ~)?
bsd-3-clause | bsd | 0.9 | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: ~)?
bsd-4-clause | bsd | 0.9 | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: ~)?
0bsd | bsd | 0.88 | (?:0bsd|zero clause bsd|bsd zero clause)(?: ~)?
bsd | bsd | 0.85 | (?:licensed|released|distributed|available|provided|published|offered) under (?:an? |the )?(?:terms of the )?bsd(?: style)?(?: ~)?
bsd | bsd | 0.78 | bsd(?: style)? (?:~|licensed)
isc | isc | 0.88 | (?:licensed|released|distributed|available|provided) under (?:the )?isc(?: ~)?
isc | isc | 0.85 | isc ~
zlib | zlib | 0.85 | zlib(?: libpng)? ~
zlib | zlib | 0.85 | (?:licensed|released|distributed|available) under (?:the )?zlib(?: libpng)?(?: ~)?
boost-1 | boost software | 0.85 | boost software ~
ofl-1.1 | open font | 0.85 | sil open font ~
unlicense | unlicense | 0.85 | (?:the|under|is) unlicense
no-license | unlicensed | 0.3 | unlicensed
sspl-1 | server side public | 0.9 | (?:mongodb )?server side public ~(?: ?(?:version |v ?)?1)?
sspl-1 | sspl | 0.85 | sspl(?: ?(?:version |v ?)?1(?: 0)?)?
public-domain | public domain | 0.8 | (?:released|placed|dedicated|put|donated|given|published) (?:in|into|to) the public domain
public-domain | public domain | 0.75 | (?:is|are|as|was|were) (?:hereby )?(?:in )?(?:the )?public domain
python-2 | psf | 0.85 | psf ~(?: agreement)?(?: (?:version |v ?)?2)?
wtfpl | wtfpl | 0.85 | wtfpl(?: ~)?
gpl | general public | 0.85 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of the )?gnu general public(?: ~)?+!
gpl | general public | 0.78 | gnu general public ~!
lgpl | lesser general public | 0.85 | gnu lesser general public ~!
lgpl | library general public | 0.85 | gnu library general public ~!
agpl | affero general public | 0.85 | gnu affero general public ~!
gpl | gpl | 0.82 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:gnu )?gpl(?: ~)?+!
lgpl | lgpl | 0.82 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:gnu )?lgpl(?: ~)?+!
agpl | agpl | 0.82 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:gnu )?agpl(?: ~)?+!
gpl | gpl | 0.6 | (?:gnu )?gpl(?: ~)?+!
lgpl | lgpl | 0.6 | (?:gnu )?lgpl(?: ~)?+!
agpl | agpl | 0.6 | (?:gnu )?agpl(?: ~)?+!
gfdl | free documentation | 0.8 | gnu free documentation ~!
mpl | mozilla public | 0.8 | mozilla public ~!
epl | eclipse public | 0.8 | eclipse public ~!
eupl | european union public | 0.8 | european union public ~!
artistic | artistic | 0.75 | (?:the )?artistic ~!
perl | perl itself | 0.8 | (?:under )?the same terms as perl itself
python-2 | python software foundation | 0.85 | python software foundation ~(?: agreement)?
postgresql | postgresql | 0.85 | postgresql ~
openssl | openssl | 0.85 | openssl ~
ncsa | ncsa | 0.85 | ncsa open source ~
vim | vim | 0.8 | vim ~
ruby | ruby | 0.75 | (?:the )?ruby ~
php-3 | php | 0.85 | php ~ (?:version |v ?)?3 0 1
w3c | w3c | 0.85 | w3c software (?:notice and )?~
beerware | beer | 0.85 | the beer ?ware ~
json | json | 0.8 | the software shall be used for good not evil
elastic-2 | elastic | 0.85 | elastic ~ (?:version |v ?)?2 0
polyform | polyform | 0.85 | polyform (?:noncommercial|small business|strict|shield|perimeter) ~
commons-clause | commons clause | 0.85 | commons clause(?: ~ condition)?
openrail | openrail | 0.85 | (?:creativeml |bigscience )?open ?rail(?: [mds]+)?(?: ~)?
llama-community | community license | 0.8 | llama [234](?: [0-9])? community ~
proprietary | commercial license | 0.6 | (?:requires|under) an? commercial ~
mit | mit | 0.8 | mit(?: ~)? or (?:at your option )?(?:the )?(?:apache|gpl|lgpl|bsd|isc|zlib)
mit | or mit | 0.8 | (?:apache|gpl|lgpl|bsd|isc|zlib)(?: ~)?(?: (?:version |v ?)?[23](?: [01])?)?(?: clause)?(?: ~)? or (?:at your option )?(?:the )?mit
mit | or the mit | 0.8 | (?:apache|gpl|lgpl|bsd|isc|zlib)(?: ~)?(?: (?:version |v ?)?[23](?: [01])?)?(?: clause)?(?: ~)? or (?:at your option )?the mit
non-commercial | non commercial | 0.6 | for non ?commercial use only
"""

#: Words that turn a statement around where they end right before a detection or run into it.
NEGATIONS = (
    r"(?:not|never|neither|nor|no longer|cannot be|isn t|aren t|wasn t|weren t|won t be)(?: (?:be|been|yet|currently|itself|being|made))* (?:licensed|released|distributed|available|provided|published|offered|covered|governed)(?: (?:under|by|as|the|a|an|any|terms|version|of))*",
    r"(?:not|never|neither|no longer|isn t|aren t|wasn t)(?: (?:under|by|the|a|an|any|terms|of))+",
    r"(?:formerly|previously)(?: (?:licensed|released|distributed|available))?(?: (?:under|by|the|a|an|terms|of))+",
    r"(?:instead of|rather than|incompatible with|unlike|without|except)(?: (?:the|a|an|any))*",
)
