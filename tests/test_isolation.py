from pathlib import Path

TOP = Path(__file__).resolve().parents[1]


def test_nothing_imports_the_training_data_operators():
    for file in [*(TOP / "siltstone").rglob("*.py"), *(TOP / "tests").glob("*.py"), TOP / "bench.py"]:
        if "llm" not in file.relative_to(TOP).parts and file.name != "test_isolation.py":
            assert "siltstone.llm" not in file.read_text() and "corpus_pipeline" not in file.read_text(), file


def test_no_driver_collects_in_operators():
    """collect() in the engine's operators would pull rows to the driver."""
    for file in (TOP / "siltstone/operators").glob("*.py"):
        assert ".collect()" not in file.read_text() and ".toPandas()" not in file.read_text(), file
