from itertools import product

import pytest

from symloom.operators import crossstack

SCHEMA = "id long, caller_symbol_id long, endpoint_symbol_id long, http_method string, endpoint_path string"


def calls(spark, urls):
    return spark.createDataFrame([(i, 1, None, m, u) for i, (m, u) in enumerate(urls)], SCHEMA)


def similar(spark, left, right, threshold=0.5):
    got = [(r.method, r.url_a, r.url_b, r.score, r.match_type) for r in crossstack.similar(calls(spark, left), calls(spark, right), threshold).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_similar_urls_need_no_equal_tail(spark):
    got = similar(spark, [("POST", "/api/albums/{id}/origin"), ("GET", None)], [("POST", "api/albums/{albumId}/status"), ("GET", "/api/albums/{id}/origin")])
    assert got == set()  # two equal places and one parameter of four come to 0.475
    got = similar(spark, [("POST", "/api/albums/${id}/origin")], [("POST", "/api/albums/{albumId}/origin")])
    assert got == {("POST", "/api/albums/{id}/origin", "/api/albums/{albumId}/origin", 0.625, "structure")}
    with pytest.raises(ValueError, match="0.4"):
        crossstack.similar(calls(spark, []), calls(spark, []), 0.1)
    assert similar(spark, [], []) == set()


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.7])
def test_similar_urls_equal_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(crossstack, "SALT", 3)
    part = ("a", "bcd", "{id}{x}{user_id}")
    urls = ["/" + "/".join((part[0], "bcd"[i % 3], ("{id}", "{userId}", "{x}", "f")[i % 4], "ij"[i % 2], str(i % 7))[: 1 + i % 5]) for i in range(60)]
    left, right = urls[:35], urls[20:]

    def fits(p, q):
        return p == q or (p[-2:].lower() == "id" and q[-2:].lower() == "id")

    want = set()
    for a, b in product(set(left), set(right)):
        x, y = a.split("/")[1:], b.split("/")[1:]
        if len(x) != len(y):
            continue
        equal = sum(p == q for p, q in zip(x, y, strict=True))
        both = [(p[1:-1], q[1:-1]) for p, q in zip(x, y, strict=True) if p != q and p[0] == q[0] == "{"]
        fit = sum(fits(*z) for z in both) / len(both) if both else 1
        score = 1.0 if x == y else round(equal / len(x) * 0.6 + len(both) / len(x) * 0.3 + fit * 0.1, 3)
        if score >= threshold:
            want.add((a, b, score))
    got = {(a, b, s) for _, a, b, s, _ in similar(spark, [("get", u) for u in left], [("GET", u) for u in right], threshold)}
    assert want and got == want


def test_patterns(spark):
    urls = [("GET", u) for u in ("`/api//users/${ user.id }/`", "/a/{p?}/b?x=1&y=2", "'/a/' + id + '/b'", "", None)]
    p = crossstack.url_pattern(crossstack.F.col("endpoint_path"))
    got = [tuple(r) for r in calls(spark, urls).orderBy("id").select(p["normalized"], p["parameters"], p["query"], p["is_static"]).collect()]
    assert got[0] == ("/api/users/{user.id}", ["user.id"], [], False)
    assert got[1] == ("/a/{p}/b", ["p"], ["x", "y"], False)
    assert got[2][0] == "'/a/{id}/b'"
    assert got[3][0] == "" and got[4] == ("", [], [], False)


def test_fallback(spark):
    got = {(r.url_a, r.url_b, r.score) for r in crossstack.basic_matches(calls(spark, [("GET", "/a/b/c")]), calls(spark, [("GET", "/a/x"), ("GET", "/q/b"), ("POST", "/a/b/c"), ("GET", "/z")])).collect()}
    assert got == {("/a/b/c", "/a/x", 0.3), ("/a/b/c", "/q/b", 0.3)}
