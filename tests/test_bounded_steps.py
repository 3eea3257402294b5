"""Steps that work on arrays instead of row by row, against the plain rules."""

import numpy as np
import pandas as pd

from fotoquarry.operators import perceptual
from fotoquarry.sources import interchange
from fotoquarry.streaming import stateful


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_pending_requests_of_frames_follow_the_rule_row_by_row():
    rng = np.random.default_rng(1)
    for _ in range(200):
        own, waits = stateful._Pending(1000), None
        own.pending = _State()
        for batch in range(3):
            n = int(rng.integers(1, 12))
            rows = pd.DataFrame({"folder": "x", "force": rng.random(n) < 0.3, "done": rng.random(n) < 0.2, "seq": batch * 100 + rng.permutation(n)})
            want = []
            for r in rows.sort_values("seq").itertuples():
                if r.done:
                    waits = None
                elif waits is None or (r.force and not waits):
                    waits = bool(r.force)
                    want.append(("x", waits, r.seq))
            cut = int(rng.integers(0, n + 1))
            got = [tuple(r) for df in own.handleInputRows(("x",), iter([rows[:cut], rows[cut:]]), None) for r in df.itertuples(index=False)]
            assert got == want and own.pending.value == (None if waits is None else (waits,))


def test_images_are_transformed_in_slices(spark, monkeypatch):
    """Whatever the size of a batch, as many images at once as ``IMAGES`` says."""
    rng, rows = np.random.default_rng(2), perceptual.IMAGES + 3
    grey = rng.integers(0, 256, (rows, 1024)).astype(float)
    df = spark.createDataFrame([(k, g) for k, g in enumerate(grey.tolist())], "id long, grey array<double>").coalesce(1)
    got = [r["h"] for r in perceptual.perceptual_hashes(df).orderBy("id").collect()]
    assert got == perceptual.fingerprints(grey).tolist()


def test_a_sidecar_is_read_in_one_pass(monkeypatch):
    import xml.etree.ElementTree as ET

    spaces, calls = "".join(f' xmlns:{k}="{v}"' for k, v in interchange.SPACES.items()), []
    text = f'<x:xmpmeta{spaces}><rdf:RDF><rdf:Description fq:managed="True"><xmp:Rating>2.6</xmp:Rating><dc:subject><rdf:Bag><rdf:li>A</rdf:li><rdf:li> b </rdf:li></rdf:Bag></dc:subject><lr:hierarchicalSubject><rdf:Bag><rdf:li>x | A</rdf:li></rdf:Bag></lr:hierarchicalSubject></rdf:Description></rdf:RDF></x:xmpmeta>'

    class Root:
        def __init__(self, e):
            self.e = e

        def iter(self, *a):
            calls.append(a)
            return self.e.iter(*a)

        def iterfind(self, *a):
            calls.append(a)
            return self.e.iterfind(*a)

    real = ET.fromstring
    monkeypatch.setattr(ET, "fromstring", lambda t: Root(real(t)))
    assert interchange._parsed("junk" + text + "tail") == ([{"name": "a", "category": "x"}, {"name": "b", "category": None}], True, 3)
    assert len(calls) == 1


def test_a_restore_keeps_photos_only_when_they_are_asked_for(spark, sf_dir, monkeypatch):
    from fotoquarry.operators import maintenance
    from fotoquarry.plans import registry

    kept, real = [], maintenance.durable
    monkeypatch.setattr(maintenance, "durable", lambda df: (kept.append(df.columns), real(df))[1])
    for name in ("restore_tag_list", "restore_categories", "import_pairs", "import_aliases", "import_refusals"):
        assert registry.QUERIES[name](spark, sf_dir) is not None
    assert not [c for c in kept if "media_type" in c]
