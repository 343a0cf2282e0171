"""Public licence texts, digests of long ones, and the notices by which licences are named in one line.

Texts have their title line, or the form that is handed on without one; both are known. Copyright lines stand for
whatever holder and year, as the canonical form drops them.
"""

from __future__ import annotations

_ISC_BODY = """THE SOFTWARE IS PROVIDED "AS IS" AND {who} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {who} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_NOTICE = """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Titles that a text may begin with, and its body.
_SHORT: dict[str, tuple[tuple[str, ...], str]] = {
    "0BSD": (
        ("BSD Zero Clause License", "Zero-Clause BSD"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_BODY.format(who="THE AUTHOR"),
    ),
    "BSD-1-Clause": (
        ("BSD 1-Clause License",),
        "\n".join((_BSD_HEAD, _BSD_1, _BSD_WARRANTY)),
    ),
    "BSD-2-Clause": (
        ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
        "\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_WARRANTY)),
    ),
    "BSD-3-Clause": (
        ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
        "\n".join((_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_WARRANTY)),
    ),
    "BSL-1.0": (
        ("Boost Software License - Version 1.0 - August 17th, 2003",),
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "Fair": (
        ("Fair License",),
        """Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument.
DISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.""",
    ),
    "FSFAP": (
        ("FSF All Permissive License",),
        "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    ),
    "ISC": (
        ("ISC License", "The ISC License", "ISC License (ISC)"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_BODY.format(who="THE AUTHOR"),
    ),
    "MIT": (
        ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
        _MIT_GRANT + _MIT_NOTICE + "\n" + _MIT_WARRANTY,
    ),
    "MIT-0": (
        ("MIT No Attribution", "MIT No Attribution License"),
        _MIT_GRANT + ".\n" + _MIT_WARRANTY,
    ),
    "Unlicense": (
        ("The Unlicense",),
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    ),
    "WTFPL": (
        ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004",),
        """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    ),
    "Zlib": (
        ("zlib License", "The zlib License", "zlib/libpng License"),
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
}

#: Licence and text, for every title of a licence and for none.
TEXTS: tuple[tuple[str, str], ...] = tuple((name, "\n".join(x for x in (title, body) if x)) for name, (titles, body) in _SHORT.items() for title in ("", *titles))

#: SHA-256 of the canonical form of texts that are too long to stand here, as their publishers give them.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "4580e5390400d27df89edd0617548ac0e66eaa029f6e07cf98aac9cd100b3a37",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    "GFDL-1.3": "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    "GPL-1.0": "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6",
    "GPL-2.0": "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1",
    "GPL-3.0": "df71f3c423c11bc52456a9775329f1d9a3168a6f071654750b9eb155fb3ec0eb",
    "LGPL-2.0": "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d",
    "LGPL-2.1": "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1",
    "MPL-2.0": "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56",
}

_NAMES = {
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the AGPL-3.0"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC0-1.0": ("CC0 1.0",),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GPL-2.0"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GPL-3.0"),
    "ISC": ("the ISC License",),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "MIT": ("the MIT License", "the MIT license"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",),
}
_VERBS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This project is licensed under", "This software is licensed under")
_SINGLE = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: Licence and one-line notice: every way to name it, its identifier line, and some that are usual besides.
NOTICES: tuple[tuple[str, str], ...] = (
    *((name, f"{verb} {form}.") for name, forms in _NAMES.items() for form in dict.fromkeys(f.lower() for f in forms) for verb in _VERBS),
    *((name, f"SPDX-License-Identifier: {name}") for name in sorted({*_NAMES, *_SHORT})),
    *_SINGLE,
)
