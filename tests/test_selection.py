import pytest
from pyspark.sql import Row

from cubeleaf.functions.selection import Selections
from cubeleaf.plans.commands import execute
from cubeleaf.table import Table


@pytest.fixture(scope="module")
def observation(spark):
    rows = [Row(SCAN_NUMBER=s, FIELD_ID=s % 3, ANTENNA1=a, ANTENNA2=b, UVW=[100.0 * b, 0.0, 5.0], DATA_DESC_ID=0) for s in range(1, 5) for a in range(3) for b in range(a, 3)]
    table = lambda r: Table.of(spark.createDataFrame(r).coalesce(1)).numbered()
    tables = {
        "ANTENNA": table([Row(NAME=n, POSITION=[x, 0.0, 0.0]) for n, x in (("A0", 0.0), ("A1", 100.0), ("B2", 1000.0))]),
        "FIELD": table([Row(NAME=n, FLAG_ROW=f) for n, f in (("x1", False), ("x2", True), ("y", False))]),
        "DATA_DESCRIPTION": table([Row(SPECTRAL_WINDOW_ID=0)]),
        "SPECTRAL_WINDOW": table([Row(REF_FREQUENCY=2.99792458e8)]),
    }
    main = Table.of(spark.createDataFrame(rows).coalesce(1))

    def count(where):
        return len(execute(f"SELECT SCAN_NUMBER FROM $1 WHERE {where}", main, resolve=Selections(tables)).df.collect())

    return count


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("mscal.scan('1~2,4')", 18), ("mscal.scan('>3')", 6), ("mscal.field('x*')", 6), ("mscal.field('1')", 12), ("mscal.field('/y/')", 6),
        ("mscal.baseline('A0')", 8), ("mscal.baseline('A0&A1')", 4), ("mscal.baseline('A*&&A*')", 12), ("mscal.baseline('2&&&')", 4), ("mscal.baseline('0&&1,2;!A1')", 4),
        ("mscal.baseline('>500m')", 8), ("mscal.baseline('/A.&B./,/^.*&.*/')", 8), ("mscal.baseline('0.05-0.5km')", 4), ("mscal.uvdist('50~150m')", 8), ("mscal.uvdist('<0.15klambda')", 12), ("mscal.scan('1') AND mscal.baseline('!0')", 4),
    ],
)
def test_selections(observation, where, n):
    assert observation(where) == n


@pytest.fixture(scope="module")
def channels(spark):
    table = lambda r: Table.of(spark.createDataFrame(r).coalesce(1)).numbered()
    day = 4_900_000_000 // 86400 * 86400.0
    rows = [Row(DATA_DESC_ID=i % 3, TIME=day + 10.0 * i, EXPOSURE=4.0, FLAG_ROW=i == 0, FEED1=i % 2, FEED2=0) for i in range(12)]
    main = Table.of(spark.createDataFrame(rows).coalesce(1)).numbered()
    tables = {
        "MAIN": main,
        "DATA_DESCRIPTION": table([Row(SPECTRAL_WINDOW_ID=1, POLARIZATION_ID=0), Row(SPECTRAL_WINDOW_ID=0, POLARIZATION_ID=1), Row(SPECTRAL_WINDOW_ID=2, POLARIZATION_ID=0)]),
        "SPECTRAL_WINDOW": table([Row(NAME="a0", CHAN_FREQ=[1e9 + 1e6 * k for k in range(8)]), Row(NAME="a1", CHAN_FREQ=[2e9 + 1e6 * k for k in range(4)]), Row(NAME="b", CHAN_FREQ=[3e9])]),
        "POLARIZATION": table([Row(CORR_TYPE=[9, 12]), Row(CORR_TYPE=[5, 8])]),
    }
    return lambda what: execute(f"SELECT {what}", main, resolve=Selections(tables)).data()


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("mscal.spw('0')", 4), ("mscal.spw('a*')", 8), ("mscal.spw('>=1')", 8), ("mscal.spw('0:9')", 0), ("mscal.spw('1~2:3,b')", 8), ("mscal.spw('*:2.0005~2.1GHz')", 4),
        ("mscal.corr('XX')", 8), ("mscal.corr('ll,YY')", 12), ("mscal.corr('5')", 4), ("mscal.feed('0&&&')", 6), ("mscal.feed('1')", 6),
        ("mscal.time('*/*/*/0:0:30~*/*/*/0:0:50')", 3), ("mscal.time('*/*/*/0:1:0')", 1), ("mscal.time('>*/*/*/0:1:40')", 2), ("mscal.time('*/*/*/0:0:20+0:0:30')", 4),
        ("mscal.time('15[*/*/*/0:0:40~*/*/*/0:0:50]')", 4), ("mscal.time('<1e4, 2014/1/1')", 0),
    ],
)
def test_windows_products_times(channels, where, n):
    assert channels(f"TIME FROM $1 WHERE {where}").count() == n


def test_channel_masks(channels):
    rows = channels("DATA_DESC_ID, mscal.chan('0:1~6^2;>6,a1:<2MHz;^3,2') AS m FROM $1").distinct().collect()
    t, f = True, False
    assert {r.DATA_DESC_ID: r.m for r in rows} == {1: [f, t, f, t, f, t, f, t], 0: [t, f, f, t], 2: [t]}


@pytest.mark.parametrize("text", ["1~x", "1~", ">a", "&", "0:1:2", "0:x~y"])
def test_what_is_no_selection(channels, text):
    from cubeleaf.plans.parser import LanguageError

    with pytest.raises(LanguageError):
        channels(f"TIME FROM $1 WHERE mscal.spw('{text}')").count()


def test_frames(spark):
    t = Table.of(spark.createDataFrame([Row(X=[-1601185.365, -5041977.547, 3554875.870])]))
    r = execute("SELECT meas.epoch('TAI', 5e9, 'UTC') - 5e9 AS a, meas.epoch('UTC', meas.epoch('TT', 5e9), 'TT') AS b, meas.wgs(X)[3] AS h, meas.wgs(meas.itrfxyz(0.3, 0.7, 1234)) AS w FROM $1", t).data().first()
    assert r.a == 37.0 and abs(r.b - 5e9) < 1e-6 and abs(r.h - 2114.9) < 1
    assert r.w == pytest.approx([0.3, 0.7, 1234.0])


def test_synthetic_observation(spark, tmp_path):
    from cubeleaf.sources import Catalog
    from cubeleaf.sources.observation import create, validate

    o = create(Catalog(spark, f"file://{tmp_path}"), rows=6, channels=2)
    assert validate(o) == []
    r = execute("SELECT gcount() AS n, gmax(ANTENNA2) AS a, gsum(real(DATA)) AS s FROM $1 WHERE mscal.baseline('ANT0&ANT1') AND shape(FLAG)[2] == 2", o.main, resolve=Selections({"ANTENNA": o["ANTENNA"]})).data().first()
    assert (r.n, r.a, r.s) == (2, 1, 0.0)
    o.catalog.drop("STATE")
    assert validate(o) == ["no table STATE"]


def test_too_many_rows_of_a_small_table_are_an_error(spark, monkeypatch):
    from cubeleaf.functions import selection
    from cubeleaf.plans.parser import LanguageError
    from cubeleaf.table import Table

    monkeypatch.setattr(selection, "MOST_NAMES", 2)
    dd = Table.of(spark.createDataFrame([(0,), (1,), (2,)], "SPECTRAL_WINDOW_ID int").coalesce(1))
    spw = Table.of(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "REF_FREQUENCY double").coalesce(1))
    few = Table.of(spark.createDataFrame([(0,)], "SPECTRAL_WINDOW_ID int"))
    antennas = Table.of(spark.createDataFrame([([0.0, 0.0, 0.0],)] * 3, "POSITION array<double>").coalesce(1))
    for tables in ({"DATA_DESCRIPTION": dd, "SPECTRAL_WINDOW": spw}, {"DATA_DESCRIPTION": few, "SPECTRAL_WINDOW": spw}):
        with pytest.raises(LanguageError):
            selection.Selections(tables)._reference_frequency()
    with pytest.raises(LanguageError):
        selection.Selections({"ANTENNA": antennas})._length()


@pytest.fixture(scope="module")
def products(spark):
    """A function of a Stokes expression over two rows of cells (4 products, 2 channels) and their numpy twins."""
    import numpy as np

    rng = np.random.default_rng(4)
    cells = [rng.normal(size=(2, 4)) + 1j * rng.normal(size=(2, 4)) for _ in range(2)]
    weights = [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 0.0, 1.0]]
    flags = [[True, False, False, False], [False, True, False, False]]
    data = [(k, {"shape": [4, 2], "data": [{"re": float(z.real), "im": float(z.imag)} for z in x.ravel()]}, w, f, [1.0, 2.0, 3.0], 0) for k, (x, w, f) in enumerate(zip(cells, weights, flags, strict=True))]
    schema = "k int, DATA struct<shape:array<int>,data:array<struct<re:double,im:double>>>, W array<double>, FL array<boolean>, UVW array<double>, DATA_DESC_ID int"
    main = Table.of(spark.createDataFrame(data, schema).coalesce(1)).numbered()
    table = lambda r: Table.of(spark.createDataFrame(r).coalesce(1)).numbered()

    def run(what, codes=(5, 6, 7, 8)):
        tables = {
            "POLARIZATION": table([Row(CORR_TYPE=list(codes))]), "DATA_DESCRIPTION": table([Row(SPECTRAL_WINDOW_ID=0)]),
            "SPECTRAL_WINDOW": table([Row(REF_FREQUENCY=2.99792458e8, CHAN_FREQ=[2.99792458e8, 5.99584916e8])]),
        }
        rows = sorted(execute(f"SELECT k, {what} AS x FROM $1", main, resolve=Selections(tables)).data().collect())
        return [r.x for r in rows]

    return run, cells


def test_products_of_circular_feeds(products):
    run, cells = products
    for got, x in zip(run("mscal.stokes(DATA, 'i,U, v,Ptotal,PFlinear,PANGLE')"), cells, strict=True):
        rr, rl, lr, ll = x.T
        q, u, v = rl + lr, 1j * (lr - rl), rr - ll
        import numpy as np

        linear = np.sqrt(abs(q) ** 2 + abs(u) ** 2)
        want = np.stack([rr + ll, u, v, np.sqrt(linear**2 + abs(v) ** 2), linear / abs(rr + ll), np.arctan2(u.real, q.real) / 2], axis=1)
        assert list(got.shape) == [6, 2]
        assert [z.re + 1j * z.im for z in got.data] == pytest.approx(list(want.ravel()))


def test_products_there_and_back(products):
    run, cells = products
    for codes in ((5, 6, 7, 8), (9, 10, 11, 12), (1, 2, 3, 4)):
        same = {5: "CIRC", 9: "linear", 1: "IQUV"}[codes[0]]
        for got, x in zip(run(f"mscal.stokes(DATA, '{same}', true)", codes), cells, strict=True):
            assert [z.re + 1j * z.im for z in got.data] == pytest.approx(list(x.ravel()))
    half, whole = run("mscal.stokes(DATA, 'I', true)"), run("mscal.stokes(DATA, 'I')")
    assert [2 * z.re for r in half for z in r.data] == pytest.approx([z.re for r in whole for z in r.data])


def test_products_of_flags_and_weights(products):
    run, _ = products
    assert run("mscal.stokes(FL, 'I,Q,XX')") == [[True, False, True], [False, True, True]]
    assert run("mscal.stokes(W, 'I,Q')") == [pytest.approx([0.8, 1.2]), [0.0, 0.0]]


def test_coordinates_in_wavelengths(products):
    run, _ = products
    assert run("mscal.uvwwvl()") == [pytest.approx([1.0, 2.0, 3.0])] * 2
    got = run("mscal.uvwwvls()")[0]
    assert list(got.shape) == [3, 2] and list(got.data) == pytest.approx([1.0, 2.0, 3.0, 2.0, 4.0, 6.0])


@pytest.mark.parametrize("what", ["mscal.stokes(DATA, 'RX')", "mscal.stokes(FL, 'PTOTAL')", "mscal.stokes()", "mscal.stokes(DATA, 'I', 1)", "mscal.stokes(DATA, W)", "mscal.stokes(k)", "mscal.stokes(DATA, ',')"])
def test_what_is_no_polarisation(products, what):
    from cubeleaf.plans.parser import LanguageError

    with pytest.raises(LanguageError):
        products[0](what)


def test_mixed_frames_are_an_error(products):
    from cubeleaf.plans.parser import LanguageError

    with pytest.raises(LanguageError):
        products[0]("mscal.stokes(DATA, 'I')", (5, 9, 7, 8))
