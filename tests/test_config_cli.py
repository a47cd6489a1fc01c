import dataclasses

import pytest

from lodeseek import cli, doctor
from lodeseek.config import Config, EmbeddingConfig, IndexConfig, load_config, save_config


def test_defaults_without_a_file(tmp_path):
    cfg = load_config(tmp_path)
    assert cfg.project.name == tmp_path.name and cfg.target == str(tmp_path)
    assert (cfg.index.max_file_bytes, cfg.index.max_chunk_chars) == (1_000_000, 2500)
    assert (cfg.embedding.dim, cfg.embedding.batch_size, cfg.embedding.timeout_seconds) == (768, 32, 60.0)


def test_round_trip(tmp_path):
    cfg = dataclasses.replace(
        Config(),
        index=IndexConfig(include_globs=('**/*.py', 'a "b" é'), max_file_bytes=7),
        embedding=EmbeddingConfig(model="other", timeout_seconds=1.5),
    )
    save_config(cfg, tmp_path)
    assert load_config(tmp_path) == dataclasses.replace(cfg, target=str(tmp_path))


def test_bad_values_are_refused(tmp_path):
    save_config(Config(), tmp_path)
    path = load_config(tmp_path).config_path
    path.write_text("[index]\nmax_file_bytes = 'big'\n[later]\nx = 1\n")
    with pytest.raises(ValueError, match="max_file_bytes"):
        load_config(tmp_path)
    path.write_text("[embedding]\ntimeout_seconds = 5\nunknown = 1\n")
    assert load_config(tmp_path).embedding.timeout_seconds == 5.0


def test_table_path():
    cfg = Config(target="/p")
    assert cfg.table_path == "/p/.lodeseek/index/chunks"
    store = dataclasses.replace(cfg.store, path="hdfs://n/x")
    assert dataclasses.replace(cfg, store=store).table_path == "hdfs://n/x/chunks"


def test_init(tmp_path, capsys):
    (tmp_path / ".gitignore").write_text("*.tmp\n")
    target = ["--target", str(tmp_path)]
    assert cli.main(["init", *target]) == 0
    assert (tmp_path / ".lodeseek/config.toml").exists() and (tmp_path / ".lodeseek/digests").is_dir()
    assert (tmp_path / ".gitignore").read_text().startswith("*.tmp\n") and ".lodeseek/" in (
        tmp_path / ".gitignore"
    ).read_text()
    assert cli.main(["init", *target]) == 1
    assert "--force" in capsys.readouterr().err
    assert cli.main(["init", *target, "--force"]) == 0
    assert (tmp_path / ".gitignore").read_text().count(".lodeseek/") == 1


def test_full_excludes_since(tmp_path, capsys):
    assert cli.main(["index", "--target", str(tmp_path), "--full", "--since", "HEAD"]) == 2
    assert "mutually exclusive" in capsys.readouterr().err


def test_index_and_searches(spark, project, capsys):
    cfg = project({"a.py": "def alpha():\n    return beta(1)\n"})
    save_config(cfg)
    target = ["--target", cfg.target]
    assert cli.main(["index", *target, "--prune"]) == 0
    shown = capsys.readouterr().out
    assert "vectors made: 1\n" in shown and "paths pruned: 0\n" in shown
    assert cli.main(["search", "alpha", *target, "--no-rerank"]) == 0
    assert "1. function alpha, a.py, lines 1 to 2, score " in capsys.readouterr().out
    assert cli.main(["lexical", "beta", *target]) == 0
    assert "a.py:2:    return beta(1)" in capsys.readouterr().out
    assert cli.main(["structural", "beta($X)", "--lang", "python", *target]) == 0
    assert "a.py:2:beta(1)" in capsys.readouterr().out
    assert cli.main(["index", *target, "--since", "HEAD"]) == 1
    assert "index failed" in capsys.readouterr().err


def test_version(capsys):
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and "lodeseek" in capsys.readouterr().out


def test_doctor(tmp_path, capsys):
    results = doctor.run_checks(tmp_path)
    levels = {r.name: r.level for r in results}
    assert levels["config"] == "WARN" and levels["table-path"] == "PASS" and levels["java"] == "PASS"
    assert cli.main(["doctor", "--target", str(tmp_path)]) == 0
    assert cli.main(["doctor", "--target", str(tmp_path), "--strict"]) == 1
    lines = capsys.readouterr().out.splitlines()
    assert "[WARN] config" in lines[4] or any("[WARN] config" in x for x in lines)
    missing = doctor.check_tool("no-such-tool", "install it", True)
    assert missing.level == "FAIL" and "install it" in missing.detail
    assert doctor.has_level([missing], "FAIL") and not doctor.has_level([missing], "WARN")


def test_checks_as_a_table(spark):
    table = doctor.checks_table(spark, [doctor.CheckResult("a", "PASS", "x")])
    assert [tuple(r) for r in table.collect()] == [("a", "PASS", "x")]
