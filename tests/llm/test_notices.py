"""Sibling licences: every notice is found as itself and as nothing else."""

import pytest

from siltworks.llm import license_scan as lic
from siltworks.llm.common import WordHashes
from siltworks.llm.license_texts import LICENSE_TEXTS

GNU = (
    "This {what} is free software{a} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free "
    "Software Foundation{b} either version {n} of the License, or (at your option) any later version. This {what} is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {kind} for more details."
)
TEXTS = {
    "GPL-2.0": GNU.format(what="program", a=";", b=";", kind="General Public License", n="2"),
    "GPL-3.0": GNU.format(what="program", a=":", b=",", kind="General Public License", n="3"),
    "LGPL-2.1": GNU.format(what="library", a=";", b=";", kind="Lesser General Public License", n="2.1"),
    "LGPL-3.0": GNU.format(what="program", a=":", b=",", kind="Lesser General Public License", n="3"),
    "AGPL-3.0": GNU.format(what="program", a=":", b=",", kind="Affero General Public License", n="3"),
    "BSD-3-Clause": LICENSE_TEXTS["BSD-2-Clause"]
    + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-short": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-short": "Licensed under CC BY-NC-SA 4.0.",
}


def names_in(text):
    templates = lic.build_templates(LICENSE_TEXTS, 0.8, 0.9999)
    return [m[1] for m in lic.matches([text.encode()], WordHashes(), templates, 0.8)]


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_siblings_are_told_apart(name):
    assert names_in("Some words before it. " + TEXTS[name] + " Some words after it.") == [name]


def test_a_changed_word_in_the_last_clause_keeps_the_longer_notice():
    assert names_in(TEXTS["BSD-3-Clause"].replace("contributors", "authors")) == ["BSD-3-Clause"]


@pytest.mark.parametrize("name", sorted(LICENSE_TEXTS))
def test_every_template_is_found_as_itself(name):
    assert names_in(LICENSE_TEXTS[name]) == [name]
