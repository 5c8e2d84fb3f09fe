from types import SimpleNamespace

from gate import learning
from tapeweave.config import BoostedClassifier


def test_event_walk_forward_fits_the_configured_classifier(monkeypatch):
    seen = []
    for name in ("weekly", "returns", "benchmark", "decision_features"):
        monkeypatch.setattr(learning, name, lambda *_: None)
    monkeypatch.setattr(learning, "event_walk_forward", lambda *a: seen.extend(a) or SimpleNamespace(split_metrics=None))
    learning._events(None, "")
    model = next(a for a in seen if isinstance(a, BoostedClassifier))
    assert model == BoostedClassifier() and (model.max_iter, model.max_depth) == (100, 5)
