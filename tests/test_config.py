import pytest

from tideline.config import KMeansOptions, LinRegOptions, MicroClusterOptions


def test_defaults_of_the_bare_call():
    options, columns = LinRegOptions.from_arguments(["y", "x"])
    assert columns == ["y", "x"]
    assert (options.learn_type, options.window_shift, options.batch_size) == (0, 1, 10)
    assert (options.num_iterations, options.step_size) == (100, 1e-8)
    assert (options.mini_batch_fraction, options.ci) == (1.0, 0.95)


def test_positional_constants():
    options, columns = LinRegOptions.from_arguments([1, 5, 20, 7, 0.1, 0.5, 0.9, "y", "x"])
    assert columns == ["y", "x"]
    assert options.shift == 5 and options.num_iterations == 7 and options.mini_batch_fraction == 0.5
    options, columns = KMeansOptions.from_arguments([0, 0, 1000, 10, 2, 1, 0.95, "a", "b"])
    assert columns == ["a", "b"] and options.num_clusters == 2 and options.alpha == 1
    options, columns = MicroClusterOptions.from_arguments([0, 0, 1000, 10, 2, 1, 0.95, "a"])
    assert columns == ["a"] and options.batch_size == 1000


@pytest.mark.parametrize(
    "arguments",
    [
        [0, 1, 10.0, 7, 0.1, 0.5, 0.9, "y", "x"],
        [0, 1, 10, 7, 1, 0.5, 0.9, "y", "x"],
        [0, 1, 10, 7, 0.1, 0.5, 1, "y", "x"],
        [0, 1, 10, 7, 0.1, "y", "x"],
        [0, 1, 10],
        [],
    ],
)
def test_wrong_constant_types(arguments):
    with pytest.raises(TypeError):
        LinRegOptions.from_arguments(arguments)


@pytest.mark.parametrize(
    "values",
    [
        {"batch_size": 0},
        {"learn_type": 3},
        {"learn_type": 1, "window_shift": 0},
        {"learn_type": 1, "window_shift": 11},
        {"ci": 1.0},
        {"mini_batch_fraction": 0.0},
        {"convergence_tol": 2.0},
        {"on_diverge": "no"},
    ],
)
def test_rejected_values(values):
    with pytest.raises(ValueError):
        LinRegOptions(**values)


def test_other_rejected_values():
    with pytest.raises(ValueError):
        KMeansOptions(init="best")
    with pytest.raises(ValueError):
        KMeansOptions(update="decay", alpha=2.0)
    with pytest.raises(TypeError):
        KMeansOptions(num_clusters=2.0)
    with pytest.raises(ValueError):
        MicroClusterOptions(radius_factor=0)
    assert KMeansOptions(learn_type=0, window_shift=0).shift == 10
