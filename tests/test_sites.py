"""Every way that a door refuses a text, and regular and odd texts it reads, in both lanes."""

import pytest

from plumbline.plans import sites


@pytest.mark.parametrize("site", sites.SITES, ids=lambda s: s.name)
def test_site(spark, site):
    want = [(None, *r[1:]) for r in site.all()] + [(x, None, None, None, None) for _, x in sites.VALUES.get(site.name, ())]
    texts = [r[0] for r in site.all()] + [t for t, _ in sites.VALUES.get(site.name, ())]
    for native in (True, False):
        got = sorted(sites.verdicts(spark, site, native).collect())
        wrong = [(native, texts[r.n][:60], tuple(r[1:]), w) for r, w in zip(got, want) if tuple(r[1:]) != w]
        assert not wrong and len(got) == len(want)
