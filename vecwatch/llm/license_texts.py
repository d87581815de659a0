"""Whole licences and licence notices as templates, see `licenses`.

A licence text counts only with its mandatory wording to the end. A notice names the license after "under", with any or no verb before it.
"""

from __future__ import annotations


def opt(wording: str) -> str:
    return f"<<beginOptional>>{wording}<<endOptional>>"


def one_of(*wordings: str) -> str:
    return f'<<choice;of="{"|".join(wordings)}">>'


def words(name: str, least: int, most: int) -> str:
    return f'<<var;name="{name}";words="{least}-{most}">>'


def numbered(*numbers: str) -> str:
    return one_of(*[f"{before}{n}" for n in numbers for before in ("", "v", "v. ", "version ", "version v")])


HOLDER = words("holder", 1, 12)
UNDER = (opt(f"This {words('subject', 1, 4)} is") + opt(one_of("licensed", "released", "distributed", "available", "made available", "provided", "published", "dual licensed"))
         + " under " + opt(one_of("the terms of", "the terms and conditions of", "terms of")) + opt(one_of("the", "a", "an")))
BULLET = lambda *marks: opt(one_of(*marks))

MIT = (f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files {opt('(the Software)')}, to deal in the Software without "
       "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
       f"Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice {opt('(including the next paragraph)')} shall be included in all "
       "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
       f"MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
       "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE")
ISC = (f"Permission to use, copy, modify, {one_of('and', 'and or')} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
       f"permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND {HOLDER} {one_of('DISCLAIMS', 'DISCLAIM')} ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
       f"WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
       "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE")
BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
            f"{BULLET('1', 'a', 'i')} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
            f"{BULLET('2', 'b', 'ii')} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution.")
BSD_ADVERT = (f"{BULLET('3', 'c', 'iii')} All advertising materials mentioning features or use of this software must display the following {one_of('acknowledgement', 'acknowledgment')}: "
              f"This product includes software developed by {words('organization', 1, 20)}")
BSD_NAMES = (f"Neither the {one_of('name', 'names')} of {words('organization', 1, 12)} nor the names of {one_of('its', 'their', 'any', 'the')} contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission.")
BSD_TAIL = (f"THIS SOFTWARE IS PROVIDED BY {HOLDER} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
            f"PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
            "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
            "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE")
APACHE_HEADER = ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                 f"{one_of('http', 'https')} www.apache.org/licenses/LICENSE-2.0 {opt(one_of('txt', 'html'))} Unless required by applicable law or agreed to in writing, software distributed under the "
                 "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
                 "limitations under the License")
LATER = opt("of the License") + opt(f"or {opt('(at your option)')} any later version")
NOTICE_TAIL = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
               "See the GNU {1} Public License for more details")


def gnu(label: str, kind: str, short: str, number: str):
    """Notices of one version: by name and version, and its name and version in short."""
    numbers = (number, number.removesuffix(".0")) if number.endswith(".0") else (number,)
    long = f"{UNDER} {opt('GNU')} {kind} Public License {opt('as published by the Free Software Foundation')} {opt('either')} {numbered(*numbers)} {LATER}"
    yield label, long + opt(NOTICE_TAIL.format(one_of("program", "library", "software", "file", "work"), kind))
    forms = [x for n in (numbers if label != "lgpl-2.0" else ("2.0",)) for x in (f"{short} {n}", f"{short} v{n}", f"{short}v{n}", f"{short} version {n}", f"{short}{n}")]
    yield label, f"{UNDER} {opt('GNU')} {one_of(*forms)} {LATER}"


#: Version of a Creative Commons license; by and by-nc need it, or "License", after them, as more parts might follow.
CC_VERSION = numbered("1", "2", "3", "4") + opt(one_of("0", "5"))
CC_PARTS = {"nc": one_of("NonCommercial", "Non Commercial"), "sa": one_of("ShareAlike", "Share Alike"), "nd": one_of("NoDerivatives", "No Derivatives", "NoDerivs", "No Derivs")}


def creative_commons(label: str, parts: str):
    own = parts.split()
    end = opt(CC_VERSION) if own and own[-1] in ("sa", "nd") else f'{opt(one_of("1.0", "2.0", "2.5", "3.0", "4.0"))}{one_of("License", "Licence")}'
    for name in (f"{opt('Creative Commons')} CC BY {parts}", "Creative Commons Attribution " + " ".join(CC_PARTS[p] for p in own)):
        yield label, f"{UNDER} {name} {end}"
        if not own or own[-1] == "nc":
            yield label, f"{UNDER} {name} {CC_VERSION}"


#: Label and wording; several wordings may share a label.
TEMPLATES = (
    ("mit", MIT), ("mit", f"{UNDER} {one_of('MIT License', 'MIT Licence', 'MIT X11 License', 'Expat License')}"),
    ("isc", ISC), ("isc", f"{UNDER} ISC {one_of('License', 'Licence')}"),
    ("bsd-2-clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("bsd-3-clause", f"{BSD_HEAD} {BULLET('3', 'c', 'iii')} {BSD_NAMES} {BSD_TAIL}"),
    ("bsd-4-clause", f"{BSD_HEAD} {BSD_ADVERT} {BULLET('4', 'd', 'iv')} {BSD_NAMES} {BSD_TAIL}"),
    *[(f"bsd-{n}-clause", f"{UNDER} {opt(one_of('original', 'simplified', 'new', 'modified', 'revised'))} {one_of(f'BSD {n} Clause', f'{n} Clause BSD', f'BSD {name} Clause', f'{name} Clause BSD')} "
       f"{one_of('License', 'Licence')}") for n, name in ((2, "two"), (3, "three"), (4, "four"))],
    ("apache", f"{UNDER} Apache {opt('Software')} License"),
    ("apache-2.0", APACHE_HEADER),
    *[(f"apache-{n}", f"{UNDER} Apache {opt('Software')} License {numbered(*numbers)}") for n, numbers in (("1.0", ("1.0",)), ("1.1", ("1.1",)), ("2.0", ("2.0", "2")))],
    ("apache-2.0", f"{UNDER} Apache {one_of('2.0', 'v2.0', 'version 2.0', 'v2', '2')} {one_of('License', 'Licence')}"),
    *gnu("gpl-1.0", "General", "GPL", "1.0"), *gnu("gpl-2.0", "General", "GPL", "2.0"), *gnu("gpl-3.0", "General", "GPL", "3.0"),
    *gnu("lgpl-2.0", "Library General", "LGPL", "2.0"), *gnu("lgpl-2.1", "Lesser General", "LGPL", "2.1"), *gnu("lgpl-3.0", "Lesser General", "LGPL", "3.0"),
    *gnu("agpl-3.0", "Affero General", "AGPL", "3.0"),
    *[(f"mpl-{n[0]}", f"{one_of('under', 'subject to')} {opt(one_of('the terms of the', 'the'))} {one_of('Mozilla Public License', 'MPL')} {numbered(*n)}") for n in (("1.0",), ("1.1",), ("2.0", "2"))],
    *creative_commons("cc-attribution", ""), *creative_commons("cc-by-sa", "sa"), *creative_commons("cc-by-nd", "nd"),
    *creative_commons("cc-by-nc", "nc"), *creative_commons("cc-by-nc-sa", "nc sa"), *creative_commons("cc-by-nc-nd", "nc nd"),
    ("cc0-1.0", f"{UNDER} {opt('Creative Commons')} {one_of('CC0', 'Zero')} {numbered('1.0')}"),
    ("copyright-notice", f"Copyright {opt('(c)')} {words('holder', 1, 8)} All rights reserved"),
)
