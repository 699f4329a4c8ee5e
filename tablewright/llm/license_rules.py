"""Signatures of licences, one to a line: priority, label, keyword, pattern.

Patterns run over the words of a text: lower case, everything that is no word character made
one space. A rule is tried only where one of its keywords (parted by |) occurs; whatever the
pattern matches must hold one. Priority 4: the words of the
licence itself or an SPDX line, 3: a notice, 2: the name with its version, 1: a loose mention.
"""

RULES = r"""
4 mit spdx spdx license identifier mit
4 mit charge permission is hereby granted free of charge to any person obtaining a copy of this software
4 mit substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions
4 mit-0 spdx spdx license identifier mit 0
4 x11 advertising except as contained in this notice the name of .{1,60} shall not be used in advertising
4 apache-2.0 spdx spdx license identifier apache 2 0
4 apache-2.0 licensed licensed under the apache license version 2 0 the license you may not use this file
4 apache-2.0 perpetual perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
4 apache-1.1 apache this product includes software developed by the apache software foundation
4 gpl-2.0-only spdx spdx license identifier gpl 2 0( only)?(?! or)
4 gpl-2.0-or-later spdx spdx license identifier gpl 2 0 (or later|\+)
4 gpl-3.0-only spdx spdx license identifier gpl 3 0( only)?(?! or)
4 gpl-3.0-or-later spdx spdx license identifier gpl 3 0 or later
4 gpl redistribute this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
4 gpl-2.0-or-later version either version 2 of the license or at your option any later version
4 gpl-3.0-or-later version either version 3 of the license or at your option any later version
4 gpl merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general
4 gpl gnu you should have received a copy of the gnu general public license
4 lgpl-2.1-only spdx spdx license identifier lgpl 2 1( only)?(?! or)
4 lgpl-2.1-or-later spdx spdx license identifier lgpl 2 1 or later
4 lgpl-3.0-only spdx spdx license identifier lgpl 3 0( only)?(?! or)
4 lgpl-3.0-or-later spdx spdx license identifier lgpl 3 0 or later
4 lgpl gnu you should have received a copy of the gnu (lesser|library) general public license
4 lgpl redistribute this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser
4 agpl-3.0-only spdx spdx license identifier agpl 3 0( only)?(?! or)
4 agpl-3.0-or-later spdx spdx license identifier agpl 3 0 or later
4 agpl affero under the terms of the gnu affero general public license
4 agpl affero you should have received a copy of the gnu affero general public license
4 bsd-2-clause spdx spdx license identifier bsd 2 clause
4 bsd-3-clause spdx spdx license identifier bsd 3 clause
4 bsd-4-clause spdx spdx license identifier bsd 4 clause
4 0bsd spdx spdx license identifier 0bsd
4 bsd-2-clause redistribution redistribution and use in source and binary forms with or without modification are permitted
4 bsd-2-clause redistributions redistributions of source code must retain the above copyright notice this list of conditions
4 bsd-2-clause redistributions redistributions in binary form must reproduce the above copyright notice
4 bsd-3-clause endorse neither the names? of .{1,80} may be used to endorse or promote products derived
4 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display
4 isc spdx spdx license identifier isc
4 isc fee permission to use copy modify and or distribute this software for any purpose with or without fee
4 0bsd fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is
4 mpl-1.1 spdx spdx license identifier mpl 1 1
4 mpl-2.0 spdx spdx license identifier mpl 2 0
4 mpl-2.0 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
4 mpl-1.1 mozilla the contents of this file are subject to the mozilla public license version 1 1
4 epl-1.0 spdx spdx license identifier epl 1 0
4 epl-2.0 spdx spdx license identifier epl 2 0
4 epl-1.0 eclipse under the terms of the eclipse public license v1 0
4 epl-2.0 eclipse under the terms of the eclipse public license 2 0
4 cddl-1.0 spdx spdx license identifier cddl 1 0
4 cddl-1.1 spdx spdx license identifier cddl 1 1
4 cddl distribution the contents of this file are subject to the terms of the common development and distribution license
4 cpl-1.0 spdx spdx license identifier cpl 1 0
4 unlicense spdx spdx license identifier unlicense
4 unlicense unencumbered this is free and unencumbered software released into the public domain
4 cc0-1.0 spdx spdx license identifier cc0 1 0
4 cc0-1.0 waived to the extent possible under law .{1,80} waived all copyright and related or neighboring rights
4 wtfpl spdx spdx license identifier wtfpl
4 wtfpl fuck you just do what the fuck you want to
4 zlib spdx spdx license identifier zlib
4 zlib misrepresented the origin of this software must not be misrepresented
4 zlib altered altered source versions must be plainly marked as such
4 bsl-1.0 spdx spdx license identifier bsl 1 0
4 bsl-1.0 boost distributed under the boost software license version 1 0
4 artistic-1.0 spdx spdx license identifier artistic 1 0
4 artistic-2.0 spdx spdx license identifier artistic 2 0
4 ms-pl spdx spdx license identifier ms pl
4 ms-rl spdx spdx license identifier ms rl
4 ofl-1.1 spdx spdx license identifier ofl 1 1
4 ofl-1.1 sil this font software is licensed under the sil open font license version 1 1
4 postgresql spdx spdx license identifier postgresql
4 python-2.0 spdx spdx license identifier (python|psf) 2 0
4 eupl-1.2 spdx spdx license identifier eupl 1 2
4 ncsa spdx spdx license identifier ncsa
4 upl-1.0 spdx spdx license identifier upl 1 0
4 busl-1.1 spdx spdx license identifier busl 1 1
4 sspl-1.0 spdx spdx license identifier sspl 1 0
4 elastic-2.0 spdx spdx license identifier elastic 2 0
4 cc-by-4.0 spdx spdx license identifier cc by 4 0
4 cc-by-sa-4.0 spdx spdx license identifier cc by sa 4 0
4 cc-by-nc-4.0 spdx spdx license identifier cc by nc 4 0
4 cc-by-nd-4.0 spdx spdx license identifier cc by nd 4 0
4 odbl-1.0 spdx spdx license identifier odbl 1 0
4 proprietary confidential|proprietary this (document|file|software) contains (confidential|proprietary) (and proprietary )?information
4 proprietary unauthorized unauthorized (copying|use|distribution|reproduction)( of this (file|document|software))? .{0,40}strictly prohibited
3 mit released released under (the )?mit licen[cs]e
3 mit licensed licensed under (the )?(terms of the )?mit licen[cs]e
3 mit distributed distributed under (the )?(terms of the )?mit licen[cs]e
3 mit available available under (the )?(terms of the )?mit licen[cs]e
3 mit copying|license|licence see (the )?(copying|license|licence)( file)? .{0,30}mit licen[cs]e
3 apache-2.0 licensed licensed under (the )?apache licen[cs]e (version |v)?2( 0)?
3 apache-2.0 released released under (the )?apache (licen[cs]e )?(version |v)?2( 0)?
3 apache-2.0 distributed distributed under (the )?(terms of the )?apache (licen[cs]e )?(version |v)?2( 0)?
3 apache-2.0 available available under (the )?(terms of the )?apache (licen[cs]e )?(version |v)?2( 0)?
3 apache-2.0 apache apache org licenses license 2 0
3 apache-1.0 licensed licensed under (the )?apache licen[cs]e (version |v)?1 0
3 apache-1.1 licensed licensed under (the )?apache licen[cs]e (version |v)?1 1
3 gpl-2.0 gnu licensed under (the )?(terms of the )?gnu general public licen[cs]e (version |v)?2( 0)?
3 gpl-3.0 gnu licensed under (the )?(terms of the )?gnu general public licen[cs]e (version |v)?3( 0)?
3 gpl-2.0 gpl (licensed|released|distributed|available) under (the )?(terms of the )?(gnu )?gpl ?(version |v)?2( 0)?
3 gpl-3.0 gpl (licensed|released|distributed|available) under (the )?(terms of the )?(gnu )?gpl ?(version |v)?3( 0)?
3 gpl-2.0 gnu (released|distributed|available|published) under (the )?(terms of the )?gnu general public licen[cs]e (version |v)?2
3 gpl-3.0 gnu (released|distributed|available|published) under (the )?(terms of the )?gnu general public licen[cs]e (version |v)?3
3 gpl-1.0 gnu licensed under (the )?(terms of the )?gnu general public licen[cs]e (version |v)?1
3 gpl gnu (licensed|released|distributed|available|published) under (the )?(terms of the )?gnu general public licen[cs]e
3 gpl-2.0 gnu gnu org licenses (old licenses )?gpl 2 0
3 gpl-3.0 gnu gnu org licenses gpl 3 0
3 gpl gnu gnu org licenses gpl
3 lgpl-2.1 gnu (licensed|released|distributed|available) under (the )?(terms of the )?gnu lesser general public licen[cs]e (version |v)?2 1
3 lgpl-3.0 gnu (licensed|released|distributed|available) under (the )?(terms of the )?gnu lesser general public licen[cs]e (version |v)?3
3 lgpl-2.0 gnu (licensed|released|distributed|available) under (the )?(terms of the )?gnu library general public licen[cs]e
3 lgpl lgpl (licensed|released|distributed|available) under (the )?(terms of the )?lgpl
3 lgpl gnu gnu org licenses (old licenses )?lgpl
3 agpl-3.0 affero (licensed|released|distributed|available) under (the )?(terms of the )?(gnu )?affero general public licen[cs]e (version |v)?3
3 agpl agpl (licensed|released|distributed|available) under (the )?(terms of the )?agpl
3 agpl gnu gnu org licenses agpl
3 bsd-2-clause bsd (licensed|released|distributed|available) under (the )?(terms of the )?(2|two) clause bsd
3 bsd-3-clause bsd (licensed|released|distributed|available) under (the )?(terms of the )?(3|three) clause bsd
3 bsd-2-clause bsd (licensed|released|distributed|available) under (the )?simplified bsd
3 bsd-3-clause bsd (licensed|released|distributed|available) under (the )?(new|revised|modified) bsd
3 bsd-4-clause bsd (licensed|released|distributed|available) under (the )?(original|old) bsd
3 bsd bsd (licensed|released|distributed|available) under (the |a )?(terms of the )?bsd( style)? licen[cs]e
3 bsd bsd use of this source code is governed by a bsd style license
3 isc isc (licensed|released|distributed|available) under (the )?(terms of the )?isc licen[cs]e
3 mpl-2.0 mozilla (licensed|released|distributed|available) under (the )?(terms of the )?mozilla public licen[cs]e (version |v)?2
3 mpl-1.1 mozilla (licensed|released|distributed|available) under (the )?(terms of the )?mozilla public licen[cs]e (version |v)?1 1
3 mpl-2.0 mozilla mozilla org mpl 2 0
3 mpl-2.0 mozilla mozilla org en us mpl 2 0
3 epl eclipse (licensed|released|distributed|available|provided) under (the )?(terms of the )?eclipse public licen[cs]e
3 epl eclipse eclipse org legal epl
3 cddl cddl (licensed|released|distributed|available) under (the )?(terms of the )?cddl
3 cpl-1.0 common (licensed|released|distributed|available) under (the )?(terms of the )?common public licen[cs]e
3 unlicense unlicense (licensed|released|distributed|available) under (the )?unlicense
3 unlicense unlicense unlicense org
3 cc0-1.0 cc0 (licensed|released|distributed|available|dedicated) (under|to|with) (the )?cc0
3 cc0-1.0 creativecommons creativecommons org publicdomain zero 1 0
3 public-domain domain (released|placed|dedicated|put) (in|into|to) the public domain
3 public-domain domain this (work|file|software|text|document) is in the public domain
3 cc-by-4.0 cc (licensed|released|available|shared|published) under (a |the )?cc by 4 0
3 cc-by-sa-4.0 cc (licensed|released|available|shared|published) under (a |the )?cc by sa 4 0
3 cc-by-nc-4.0 cc (licensed|released|available|shared|published) under (a |the )?cc by nc 4 0
3 cc-by-nd-4.0 cc (licensed|released|available|shared|published) under (a |the )?cc by nd 4 0
3 cc-by-nc-sa-4.0 cc (licensed|released|available|shared|published) under (a |the )?cc by nc sa 4 0
3 cc-by-nc-nd-4.0 cc (licensed|released|available|shared|published) under (a |the )?cc by nc nd 4 0
3 cc-by-3.0 cc (licensed|released|available|shared|published) under (a |the )?cc by 3 0
3 cc-by-sa-3.0 cc (licensed|released|available|shared|published) under (a |the )?cc by sa 3 0
3 cc-by creativecommons creativecommons org licenses by \d 0
3 cc-by-sa creativecommons creativecommons org licenses by sa \d 0
3 cc-by-nc creativecommons creativecommons org licenses by nc \d 0
3 cc-by-nd creativecommons creativecommons org licenses by nd \d 0
3 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa \d 0
3 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd \d 0
3 wtfpl wtfpl (licensed|released|distributed|available) under (the )?wtfpl
3 zlib zlib (licensed|released|distributed|available) under (the )?zlib( libpng)? licen[cs]e
3 bsl-1.0 boost boost org license 1 0
3 bsl-1.0 boost (licensed|released|distributed|available) under (the )?boost software licen[cs]e
3 artistic artistic (licensed|released|distributed|available) under (the )?(terms of the )?(perl )?artistic licen[cs]e
3 perl perl (same terms as perl itself|under the same terms as perl)
3 ms-pl microsoft (licensed|released|distributed|available) under (the )?microsoft public licen[cs]e
3 ms-rl microsoft (licensed|released|distributed|available) under (the )?microsoft reciprocal licen[cs]e
3 ofl-1.1 ofl|font (licensed|released|distributed|available) under (the )?(sil )?(ofl|open font licen[cs]e)
3 ofl-1.1 sil scripts sil org ofl
3 eupl eupl (licensed|released|distributed|available) under (the )?eupl
3 eupl european (licensed|released|distributed|available) under (the )?european union public licen[cs]e
3 gfdl gnu under the terms of the gnu free documentation licen[cs]e
3 gfdl gnu (licensed|released|distributed|available) under (the )?gnu free documentation licen[cs]e
3 odbl open (licensed|released|made available) under (the )?open database licen[cs]e
3 odc-by open (licensed|released|made available) under (the )?open data commons attribution licen[cs]e
3 pddl dedication (licensed|released|made available) under (the )?(open data commons )?public domain dedication and licen[cs]e
3 ogl open contains public sector information licensed under the open government licen[cs]e
3 sspl-1.0 sspl|server (licensed|released|distributed|available) under (the )?(server side public licen[cs]e|sspl)
3 busl-1.1 business (licensed|released|distributed|available) under (the )?business source licen[cs]e
3 elastic-2.0 elastic (licensed|released|distributed|available) under (the )?elastic licen[cs]e
3 commons-clause clause the software is provided to you .{0,60}commons clause
3 json evil the software shall be used for good not evil
3 beerware beer you can buy me a beer in return
3 proprietary rights all rights reserved
3 proprietary permission (may not be reproduced|no part of this) .{0,80}without (the )?(prior )?(written )?permission
2 mit mit (the )?mit licen[cs]e
2 mit expat expat licen[cs]e
2 x11 x11 x11 licen[cs]e
2 apache-2.0 apache apache (licen[cs]e )?(version |v)?2( 0)?
2 apache-1.1 apache apache licen[cs]e (version |v)?1 1
2 gpl-2.0 general general public licen[cs]e (version |v)?2( 0)?
2 gpl-3.0 general general public licen[cs]e (version |v)?3( 0)?
2 gpl-2.0 gpl gpl ?(version |v)?2( 0)?
2 gpl-3.0 gpl gpl ?(version |v)?3( 0)?
2 lgpl-2.1 lesser|library (lesser|library) general public licen[cs]e (version |v)?2 1
2 lgpl-3.0 lesser lesser general public licen[cs]e (version |v)?3( 0)?
2 lgpl lesser lesser general public licen[cs]e
2 lgpl-2.1 lgpl lgpl ?(version |v)?2 1
2 lgpl-3.0 lgpl lgpl ?(version |v)?3( 0)?
2 agpl-3.0 affero affero general public licen[cs]e (version |v)?3( 0)?
2 agpl affero affero general public licen[cs]e
2 agpl-3.0 agpl agpl ?(version |v)?3( 0)?
2 bsd-2-clause bsd ((2|two) clause bsd|bsd (2|two) clause|simplified bsd|freebsd licen[cs]e)
2 bsd-3-clause bsd ((3|three) clause bsd|bsd (3|three) clause|(new|revised|modified) bsd)
2 bsd-4-clause bsd ((4|four) clause bsd|bsd (4|four) clause|original bsd)
2 mpl-2.0 mozilla mozilla public licen[cs]e (version |v)?2( 0)?
2 mpl-1.1 mozilla mozilla public licen[cs]e (version |v)?1 1
2 mpl mozilla mozilla public licen[cs]e
2 epl-2.0 eclipse eclipse public licen[cs]e (version |v)?2( 0)?
2 epl-1.0 eclipse eclipse public licen[cs]e (version |v)?1( 0)?
2 edl-1.0 eclipse eclipse distribution licen[cs]e
2 cddl development common development and distribution licen[cs]e
2 cc-by-4.0 attribution creative commons attribution 4 0
2 cc-by-3.0 attribution creative commons attribution 3 0
2 cc-by-sa-4.0 attribution creative commons attribution share ?alike 4 0
2 cc-by-sa-3.0 attribution creative commons attribution share ?alike 3 0
2 cc-by-nc-4.0 attribution creative commons attribution non ?commercial 4 0
2 cc-by-nc-sa-4.0 attribution creative commons attribution non ?commercial share ?alike 4 0
2 cc-by-nd-4.0 attribution creative commons attribution no ?derivatives 4 0
2 cc-by-nc-nd-4.0 attribution creative commons attribution non ?commercial no ?derivatives 4 0
2 cc-by-4.0 cc cc by 4 0
2 cc-by-sa-4.0 cc cc by sa 4 0
2 cc-by-nc-4.0 cc cc by nc 4 0
2 cc-by-nc-sa-4.0 cc cc by nc sa 4 0
2 cc-by-nc-nd-4.0 cc cc by nc nd 4 0
2 cc0-1.0 cc0 cc0( 1 0)?
2 artistic-2.0 artistic artistic licen[cs]e (version |v)?2( 0)?
2 bsl-1.0 boost boost software licen[cs]e
2 zlib zlib zlib( libpng)? licen[cs]e
2 isc isc isc licen[cs]e
2 ofl-1.1 sil sil open font licen[cs]e
2 wtfpl wtfpl wtfpl
2 gfdl gnu gnu free documentation licen[cs]e
2 python-2.0 python|psf (python software foundation licen[cs]e|psf licen[cs]e)
2 postgresql postgresql postgresql licen[cs]e
2 ncsa illinois university of illinois ncsa open source licen[cs]e
2 openssl openssl openssl licen[cs]e
2 php-3.01 php php licen[cs]e
2 ruby ruby ruby licen[cs]e
2 vim vim vim licen[cs]e
2 w3c w3c w3c software (notice and )?licen[cs]e
2 unicode-dfs unicode unicode (data files and software )?licen[cs]e
2 openrail rail (creativeml )?open rail
2 llama-community llama llama( \d)? community licen[cs]e
1 gpl general general public licen[cs]e
1 gpl gpl gpl
1 lgpl lgpl lgpl
1 agpl agpl agpl
1 apache apache apache licen[cs]e
1 bsd bsd bsd licen[cs]e
1 epl eclipse eclipse public licen[cs]e
1 artistic artistic artistic licen[cs]e
1 creative-commons creative creative commons
1 public-domain domain public domain
1 copyright copyright copyright (c )?(19|20)\d\d
1 open-source open open source licen[cs]e
"""
