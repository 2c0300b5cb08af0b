import itertools

import numpy as np
import pytest

from seqloom.operators.chain import Chain, best_path
from seqloom.operators.crf import LinearChainCRF, LinearChainCRFModel
from seqloom.operators.crf_layout import Layout, likelihood, stacks

STATE = np.log([[0.4, 0.5, 0.1], [0.4, 0.1, 0.5], [0.4, 0.1, 0.5]])
TRANS = np.log([[0.3, 0.1, 0.4], [0.6, 0.2, 0.1], [0.5, 0.2, 0.1]])


def test_known_lattice():
    chain = Chain(STATE, TRANS)
    assert chain.log_norm == pytest.approx(-2.3361418765)
    path, score = best_path(STATE, TRANS)
    assert path.tolist() == [1, 0, 2] and np.exp(score) == pytest.approx(0.024)
    assert chain.node_marginals()[1] == pytest.approx([0.641571872, 0.051292658, 0.307135471])
    assert chain.edge_marginals()[0, 1] == pytest.approx([0.409514, 0.032058, 0.069804], abs=1e-6)


@pytest.mark.parametrize("seed", range(5))
def test_lattice_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    n, labels = int(rng.integers(1, 5)), int(rng.integers(1, 4))
    state, trans = rng.normal(0, 3, (n, labels)), rng.normal(0, 3, (labels, labels))
    chain = Chain(state, trans)
    all_ = {p: np.exp(chain.score(np.array(p))) for p in itertools.product(range(labels), repeat=n)}
    z = sum(all_.values())
    assert chain.log_norm == pytest.approx(np.log(z))
    for t, y in itertools.product(range(n), range(labels)):
        assert chain.node_marginals()[t, y] == pytest.approx(sum(v for p, v in all_.items() if p[t] == y) / z)
    assert all_[tuple(best_path(state, trans)[0])] == pytest.approx(max(all_.values()))
    if n > 2:
        assert chain.path_marginal(np.array([0, 0]), 1) == pytest.approx(sum(v for p, v in all_.items() if p[1:3] == (0, 0)) / z)


def test_ties_go_to_the_lower_label():
    assert best_path(np.zeros((3, 3)), np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    layout = Layout([(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, 1), (3, 1, 0, 0), (4, 1, 0, 1), (5, 1, 1, 0)], 2, 2)
    sizes = np.array([2, 0, 1])
    item = {"y": np.array([0, 1, 0]), "sizes": sizes, "at": np.repeat(np.arange(3), sizes), "aids": np.array([0, 1, 1]), "values": np.array([1.0, 0.5, 2.0])}
    w = np.append(rng.normal(size=6), 0.0)
    grad = np.zeros(7)
    likelihood(layout, w, item, grad)
    for k in range(6):
        e = np.zeros(7)
        e[k] = 1e-6
        slope = (likelihood(layout, w + e, item, np.zeros(7)) - likelihood(layout, w - e, item, np.zeros(7))) / 2e-6
        assert grad[k] == pytest.approx(slope, abs=1e-5)


def test_stacked_sequences_give_what_each_gives(monkeypatch):
    monkeypatch.setattr("seqloom.operators.crf_layout.STACK", 600)
    rng = np.random.default_rng(5)
    states = [(0, a, y) for a in range(4) for y in range(3)]
    moves = [(1, i, j) for i in range(3) for j in range(3) if (i, j) != (1, 2)]
    layout = Layout([(k, *f) for k, f in enumerate(states + moves)], 4, 3)
    w = np.append(3 * rng.normal(size=layout.size), 0.0)
    items = []
    for n in (1, 1, 2, 40, *rng.integers(1, 30, 20)):
        sizes = rng.integers(0, 3, n)
        items.append({"y": rng.integers(0, 3, n), "sizes": sizes, "at": np.repeat(np.arange(n), sizes), "aids": rng.integers(0, 4, sizes.sum()), "values": rng.normal(size=sizes.sum())})
    one, many, loss = np.zeros(layout.size + 1), np.zeros(layout.size + 1), 0.0
    for item in items:
        chain = Chain(*layout.scores(w, item))
        layout.add_nodes(one, item, chain.node_marginals(), 1.0)
        if len(item["y"]) > 1:
            np.add.at(one, layout.trans, chain.edge_marginals().sum(0))
        layout.add_path(one, item, item["y"], -1.0)
        loss -= chain.log_probability(item["y"])
    joined = [*stacks(items, 3)]
    assert 1 < len(joined) < len(items)
    assert sum(likelihood(layout, w, item, many) for item in joined) == pytest.approx(loss)
    assert many[:-1] == pytest.approx(one[:-1], abs=1e-9)


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(30):
        for p in range(6):
            y = "xyz"[int(rng.integers(3))]
            rows.append((s, p, y, [(f"is{y}", 1.0), ("bias", 1.0)]))
    return spark.createDataFrame(rows, "seq long, pos int, label string, feats array<struct<attr:string,value:double>>")


@pytest.mark.parametrize("settings", [{"algorithm": "lbfgs"}, {"algorithm": "lbfgs", "c1": 0.5, "c2": 0.0}, {"algorithm": "ap"}, {"algorithm": "pa"}, {"algorithm": "arow"}, {"algorithm": "l2sgd", "c2": 0.1, "period": 3}])
def test_trainers_learn_a_separable_set(spark, toy, settings):
    model = LinearChainCRF(maxIter=20, partitions=2, **settings).fit(toy)
    rows = model.transform(toy).collect()
    assert len(rows) == 180 and sum(r["pred"] == r["label"] for r in rows) >= 175


def test_model_is_saved_and_loaded(spark, toy, tmp_path):
    model = LinearChainCRF(maxIter=5).fit(toy)
    model.save(str(tmp_path / "m"))
    again = LinearChainCRFModel.load(str(tmp_path / "m"))
    key = lambda r: (r["seq"], r["pos"])
    one, two = (sorted(m.transform(toy).collect(), key=key) for m in (model, again))
    assert [(r["pred"], round(r["marginal"], 9)) for r in one] == [(r["pred"], round(r["marginal"], 9)) for r in two]
    assert model.dump(spark).where("type = 1").count() == 9


def test_unknown_attributes_and_labels(spark, toy):
    model = LinearChainCRF(maxIter=3).fit(toy)
    new = spark.createDataFrame([(1, 0, None, [("never", 1.0)]), (1, 1, "other", [])], toy.schema)
    assert [r["pred"] in "xyz" for r in model.transform(new).collect()] == [True, True]


def test_resumes_where_it_stopped(spark, toy, tmp_path):
    """A training cut short and resumed goes the way of one that was not; other settings begin anew."""
    seen = {}

    def train(name, state, **settings):
        losses = seen[name] = []
        trainer = LinearChainCRF(stateFile=state, period=0, partitions=2, **settings)
        trainer.listener = lambda k, loss: losses.append((k, loss))
        return trainer.fit(toy).weights

    path = str(tmp_path / "state")
    whole = train("whole", "", maxIter=14, c2=0.01)
    train("cut", path, maxIter=14, c2=0.01)
    assert train("again", path, maxIter=14, c2=0.01) == pytest.approx(whole, abs=1e-8)
    assert seen["again"][0][0] == 12 and seen["again"][-1][1] == pytest.approx(seen["whole"][-1][1])
    train("other", path, maxIter=14, c2=0.02)
    assert seen["other"][0][0] == 1


def test_probabilities_of_paths_and_spans(spark, toy):
    from seqloom.operators.crf_layout import items_of, pack

    model = LinearChainCRF(maxIter=4).fit(toy)
    rows = toy.where("seq < 3").unionByName(spark.createDataFrame([(9, 0, "never", [("bias", 1.0)])], toy.schema))
    chains = {i["seq"]: (Chain(*model.layout.scores(model.weights, i)), i["y"]) for f in [pack(rows, model.attrs, model.labels).toPandas()] for i in items_of(f)}
    for r in model.path_probability(rows).collect():
        chain, y = chains[r["seq"]]
        assert r["log_norm"] == pytest.approx(chain.log_norm)
        assert r["probability"] is None if r["seq"] == "9" else r["probability"] == pytest.approx(np.exp(chain.log_probability(y)))
    spans = [("0", 0, ["x"]), ("0", 2, ["x", "y", "z"]), ("1", 4, ["z", "z"]), ("1", 5, ["z", "z"]), ("2", 0, ["never"]), ("2", 0, []), ("2", -1, ["x"])]
    got = {(r["seq"], r["begin"], *r["labels"]): r["probability"] for r in model.span_probability(rows, spark.createDataFrame(spans, "seq string, begin long, labels array<string>")).collect()}
    for seq, begin, labels in spans:
        chain, _ = chains[seq]
        fits = labels and 0 <= begin <= 6 - len(labels) and "never" not in labels
        want = None
        if fits:  # by summing over all paths
            want = sum(np.exp(chain.log_probability(np.array(p))) for p in itertools.product(range(3), repeat=6) if ["xyz"[y] for y in p[begin : begin + len(labels)]] == labels)
        assert got[seq, begin, *labels] == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("c1", [0.0, 0.4])
def test_training_ends_where_the_slope_is_small(spark, toy, c1):
    """By the trainer's own rule: the gradient, one-sided with L1, against the weights' length."""
    from seqloom.operators.crf import objective
    from seqloom.operators.crf_layout import pack
    from seqloom.operators.optimize import pseudo_gradient

    trainer = LinearChainCRF(period=0, partitions=2, c1=c1)
    model = trainer.fit(toy)
    w = model.weights[:-1]
    value, gradient = objective(pack(toy, model.attrs, model.labels), model.layout, 1.0)(w)
    assert trainer.result.why == "converged" and trainer.result.value == pytest.approx(value + c1 * np.abs(w).sum())
    assert np.linalg.norm(pseudo_gradient(w, gradient, c1)) <= 1e-5 * max(1.0, np.linalg.norm(w)) * 1.01


def test_online_epochs_do_not_hold_what_they_have_passed(spark, toy):
    """Any number of partitions and of frames; the driver's sums of many vectors go through groups."""
    from seqloom.operators import crf

    model = LinearChainCRF(algorithm="ap", maxIter=3, partitions=70).fit(toy)  # more than 4 * GROUPS
    assert 70 > 4 * crf.GROUPS and model.transform(toy).count() == 180


@pytest.mark.parametrize("labels", [1, 2, 5, 10, 11])
def test_best_paths_of_few_and_of_many_labels_are_the_same(monkeypatch, labels):
    """Sums written out for few labels, and arrays in parts: scores to the last bit, ties to the lower label."""
    from seqloom.operators import chain

    rng = np.random.default_rng(labels)
    for k in range(30):
        state, trans = rng.normal(0, 3, (int(rng.integers(1, 40)), labels)), rng.normal(0, 3, (labels, labels))
        if k % 2:
            state, trans = np.round(state), np.round(trans)
        found = []
        for few, held in ((11, 1), (0, 1), (0, 5 * labels**2)):
            monkeypatch.setattr(chain, "FEW", few)
            monkeypatch.setattr(chain, "HELD", held)
            found.append(best_path(state, trans))
        score, back = state[0], []
        for row in state[1:]:
            reach = score[:, None] + trans
            back, score = [*back, reach.argmax(0)], reach.max(0) + row
        path = [int(score.argmax())]
        for row in reversed(back):
            path.append(int(row[path[-1]]))
        assert all((p.tolist(), top) == (path[::-1], float(score.max())) for p, top in found)


def test_sequences_are_joined_once_for_all_evaluations(spark, toy):
    """Stacks hold each kind of item once and give the loss and gradient of single sequences; batches keep sequences and their order."""
    from seqloom.operators.crf_layout import batches_of, items_of, joined, pack, stacked, stacks_of

    model = LinearChainCRF(maxIter=2).fit(toy)
    packed = pack(toy.unionByName(spark.createDataFrame([(99, 0, "x", []), (99, 1, "y", [("isx", 2.0)])], toy.schema)), model.attrs, model.labels).coalesce(1).persist()
    items = [*items_of(packed.toPandas())]
    one, many = np.zeros(model.layout.size + 1), np.zeros(model.layout.size + 1)
    loss = sum(likelihood(model.layout, model.weights, i, one) for i in items)
    stack = [*stacks_of(stacked(packed, 3).toArrow().to_batches())]
    assert sum(len(s["sizes"]) for s in stack) == 5 < sum(len(s["y"]) for s in stack) == 182
    assert sum(likelihood(model.layout, model.weights, s, many) for s in stack) == pytest.approx(loss)
    assert many[:-1] == pytest.approx(one[:-1], abs=1e-9)
    again = [i for batch in batches_of(joined(packed).toArrow().to_batches()) for i in batch]
    assert len(again) == len(items) and all((a[k] == b[k]).all() for a, b in zip(again, items) for k in ("y", "sizes", "at", "aids", "values"))


@pytest.mark.parametrize("apart", [0.0, 0.3, 3.0, 20.0, 80.0])
def test_sums_in_pieces_are_those_of_a_chain(monkeypatch, apart):
    """Short and long sequences, few and many labels, scaled between pieces or not. Scores that are near each other need no step for each item."""
    from seqloom.operators import chain

    rng, taken = np.random.default_rng(7), []
    monkeypatch.setattr(chain, "Chain", lambda *a: taken.append(len(a[0])) or Chain(*a))
    for n, labels in itertools.product((1, 2, 3, 4, 5, 17, 67, 400), (1, 2, 5, 10, 11)):
        state, trans = rng.normal(0, apart, (n, labels)), rng.normal(0, apart / 2, (labels, labels))
        before = len(taken)
        log_norm, nodes, edges = chain.chain_sums(state, trans)
        assert labels > 10 or apart > 1 or len(taken) == before
        plain = Chain(state, trans)
        assert log_norm == pytest.approx(plain.log_norm, rel=1e-12, abs=1e-12)
        assert nodes == pytest.approx(plain.node_marginals(), rel=1e-9, abs=1e-300) and edges == pytest.approx(plain.edge_marginals().sum(0), rel=1e-9, abs=1e-300)


def test_sequences_in_groups_are_known_as_each_is(monkeypatch):
    """In the order asked for, each with its own features, labels and pairs; an attribute may have no feature, an item no attribute."""
    from seqloom.operators import crf_layout

    monkeypatch.setattr(crf_layout, "SPREAD", 300)
    rng = np.random.default_rng(9)
    layout = Layout([(k, *f) for k, f in enumerate([(0, a, y) for a in (0, 2, 3) for y in range(a, 4)] + [(1, 0, 1), (1, 2, 2)])], 4, 4)
    items = []
    for n in (1, 1, 2, 90, *rng.integers(1, 20, 30)):
        sizes = rng.integers(0, 3, n)
        items.append({"y": rng.integers(0, 4, n), "sizes": sizes, "at": np.repeat(np.arange(n), sizes), "aids": rng.integers(0, 4, sizes.sum()), "values": rng.normal(size=sizes.sum())})
    alone, order = [dict(i) for i in items], rng.permutation(len(items))
    found = [*crf_layout.spread_in_order(layout, items, order)]
    assert items == [None] * len(order) and len(found) == len(order)
    w = np.append(rng.normal(size=layout.size), 0.0)
    for item, k in zip(found, order):
        one, y = alone[k], alone[k]["y"]
        assert all(a.tolist() == b.tolist() for a, b in zip((*item["spread"], *item["gold"]), (*layout.spread(one), *layout.gold(one))))
        state = np.zeros((len(y), 4))
        for at, aid, value in zip(one["at"], one["aids"], one["values"]):
            for fid, label in zip(layout.fids[layout.first[aid] : layout.first[aid + 1]], layout.lids[layout.first[aid] : layout.first[aid + 1]]):
                state[at, label] += w[fid] * value
        own, seen = item["gold"]
        assert layout.scores(w, item)[0] == pytest.approx(state) and state.ravel()[own].tolist() == state[np.arange(len(y)), y].tolist()
        assert all(seen[i, j] == sum((a, b) == (i, j) for a, b in itertools.pairwise(y.tolist())) for i in range(4) for j in range(4))
