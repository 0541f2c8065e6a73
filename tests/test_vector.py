import pytest
from pyspark.sql import functions as F

from quillvec.functions import vector as V


def arr(*xs):
    return F.array(*[F.lit(float(x)).cast("float") for x in xs]).cast("array<float>")


def null():
    return F.lit(None).cast("array<float>")


def test_cosine_edges(one_row):
    r = one_row(
        plain=V.cosine_similarity(arr(1, 0), arr(1, 1)),
        same=V.cosine_similarity(arr(3, 4), arr(3, 4)),
        zero=V.cosine_similarity(arr(0, 0), arr(1, 1)),
        sizes=V.cosine_similarity(arr(1, 2, 3), arr(1, 2)),
        null=V.cosine_similarity(null(), arr(1)),
        empty=V.cosine_similarity(F.array().cast("array<float>"), F.array().cast("array<float>")),
        distance=V.cosine_distance(arr(1, 0), arr(-1, 0)),
    )
    assert r.plain == pytest.approx(0.5**0.5)
    assert r.same == pytest.approx(1.0)
    assert (r.zero, r.sizes, r.null, r.empty) == (0.0, 0.0, 0.0, 0.0)
    assert r.distance == pytest.approx(2.0)


def test_l2(one_row):
    r = one_row(d=V.l2_squared(arr(1, 2), arr(4, 6)), n=V.l2_normalize(arr(3, 4)), z=V.l2_normalize(arr(0, 0)))
    assert r.d == 25.0
    assert r.n == pytest.approx([0.6, 0.8])
    assert r.z == [0.0, 0.0]


def test_json_forms(one_row):
    r = one_row(
        text=V.vector_to_json(arr(0.5, -1)),
        back=V.vector_from_json(F.lit("[0.5,-1.0]")),
        empty=V.vector_from_json(F.lit("[]")),
        broken=V.vector_from_json(F.lit("[0.5, oops")),
        words=V.vector_from_json(F.lit('["a", 1]')),
        null=V.vector_from_json(F.lit(None).cast("string")),
        native=V.resolve_vector(arr(1), F.lit("[2]")),
        decoded=V.resolve_vector(null(), F.lit("[2]")),
    )
    assert r.text == "[0.5,-1.0]" and r.back == [0.5, -1.0]
    assert r.empty == [] and r.broken is None and r.words is None and r.null is None
    assert r.native == [1.0] and r.decoded == [2.0]


def test_string_form(one_row):
    r = one_row(s=V.vector_to_string(arr(0.1234567, -2, 1e-9)))
    assert r.s == "[0.123457,-2.000000,0.000000]"


def test_dimension(one_row):
    r = one_row(ok=V.dimension_ok(arr(1, 2), 2), bad=V.dimension_ok(arr(1), 2), null=V.dimension_ok(null(), 2),
                usable=V.has_embedding(arr(1)), empty=V.has_embedding(F.array().cast("array<float>")))
    assert (r.ok, r.bad, r.null, r.usable, r.empty) == (True, False, False, True, False)
    with pytest.raises(Exception, match="expected 3 dimensions"):
        one_row(x=V.require_dimension(arr(1, 2), 3))
