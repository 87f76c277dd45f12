"""Entire licence files with their titles and copyright lines."""

import os

import pytest
from test_text_ops import docs_of

from porelight.llm import licenses
from porelight.llm.license_texts import FULL_TEXTS

FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
TITLES = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License", "Unlicense": "The Unlicense"}


def test_titled_files(spark):
    names = list(TITLES)
    texts = [f"{TITLES[n]}\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n{FULL_TEXTS[n]}\n" for n in names] + ["MIT License\n\nAnother text."]
    found = {x.doc_id: x.text_license for x in licenses.scan(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == [*names, ""]


@pytest.mark.skipif(not all(os.path.isfile(f"/usr/share/common-licenses/{f}") for f in FILES.values()), reason="needs the system's licence files")
def test_long_texts(spark):
    texts = [open(f"/usr/share/common-licenses/{f}").read() for f in FILES.values()]
    found = {x.doc_id: x.text_license for x in licenses.scan(docs_of(spark, texts)).collect()}
    assert [found[i] for i in range(len(texts))] == list(FILES)
