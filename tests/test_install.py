import io
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F
from weftline import __main__ as cli
from weftline.operators import ini, makefile, packaging, release
from weftline.plans import commands
from weftline.sources import sink
from weftline.sources.lines import require, with_missing

TEXTS = "path string, text string"


def run_ini(spark, text):
    request = spark.createDataFrame([("i", "https://x/y.zip", "sty", "voc", "warning")], "path string, packages_url string, style_name string, vocab_name string, min_alert_level string")
    files = spark.createDataFrame([] if text is None else [("i", text)], TEXTS)
    return ini.update_ini(request, files).first()["text"]


def test_ini_is_created_in_order(spark):
    text = run_ini(spark, None)
    assert text.startswith("Packages = https://x/y.zip\nMinAlertLevel = warning\nVocab = voc\n\n[docs/**/*.{md,markdown,mdx}]\nBasedOnStyles = sty\n# Ignore for footnotes\nBlockIgnores = (?m)")
    assert [line for line in text.splitlines() if line.startswith("[")] == ["[docs/**/*.{md,markdown,mdx}]", "[AGENTS.md]", "[*.{rs,ts,js,sh,py}]", "[README.md]"]
    assert text.endswith("sty.Pronouns = NO\n") and "sty.RustNoRun = NO\nsty.Acronyms = NO\n" in text


def test_ini_merge_keeps_what_is_there(spark):
    old = "; c\nStylesPath = styles\nVocab = old\n\n[README.md]\nextra = 1\nBasedOnStyles = Other\n[zeta]\nk = a=b\n[alpha]\nx = 1\n[zeta]\nk = 2\nj=3\nno pair\n[empty]\n"
    text = run_ini(spark, old)
    assert text.startswith("Packages = https://x/y.zip\nMinAlertLevel = warning\nVocab = voc\nStylesPath = styles\n\n")
    assert "[README.md]\nBasedOnStyles = sty\nsty.Pronouns = NO\nextra = 1\n\n[alpha]\nx = 1\n\n[empty]\n\n[zeta]\nk = 2\nj = 3\n" in text and text.endswith("j = 3\n")


def run_make(spark, text, steps=()):
    request = spark.createDataFrame([("m", list(steps))], "path string, steps array<string>")
    return makefile.update_makefiles(request, spark.createDataFrame([] if text is None else [("m", text)], TEXTS)).first()["text"]


RECIPE = "vale: $(VALE) ## Check prose\n\t$(VALE) sync\n{}\t$(VALE) --no-global .\n"


def test_makefile_new_old_and_present(spark):
    assert run_make(spark, None) == ".PHONY: vale\n\nVALE ?= vale\n" + "\n" + RECIPE.format("")
    text = run_make(spark, ".PHONY: test\n\nvale: old\n\told\n\n\nlint:\n\techo\n", ["a b", "c"])
    assert text == "VALE ?= vale\n\n.PHONY: test vale\n\n" + RECIPE.format("\ta b\n\tc\n") + "lint:\n\techo\n"
    assert run_make(spark, text, ["a b", "c"]) == text
    assert run_make(spark, "VALE := x\nall:\n\ttrue\n") == ".PHONY: vale\n\nVALE := x\nall:\n\ttrue\n\n" + RECIPE.format("")


def test_releases(spark):
    rows = [("o/r", "r", "1.0", None, None), ("o/r", "r", "1.0", "t", None), ("o/r", "r", None, "t", release.payload_of(" v9-auto ", "r-9-auto.zip", "a.zip")), ("o/r", "r", None, None, release.payload_of("v2", "x.txt", "b.zip")), ("o/r", "r", None, None, '{"tag_name":"2"}'), ("o/r", "r", "", None, '{"assets":[]}')]
    got = release.resolve_releases(spark.createDataFrame(rows, "repo string, style_name string, override_version string, override_tag string, payload string")).collect()
    assert [(r["version"], r["tag"]) for r in got[:5]] == [("1.0", "v1.0"), ("1.0", "t"), ("9-auto", "v9-auto"), ("2", "v2"), ("2", "2")]
    assert [r["packages_url"].rsplit("/", 1)[1] for r in got[:5]] == ["r-1.0.zip", "r-1.0.zip", "r-9-auto.zip", "b.zip", "r-2.zip"]
    assert got[5]["error"] == "Release payload missing tag_name"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def manifest(spark, archive, fail=True):
    df = spark.createDataFrame([("dflt", archive)], "style_name string, archive binary")
    return release.read_manifests(df, fail).first()


def test_manifests(spark):
    step = '[[install.post_sync_steps]]\naction = "update-tengo-map"\nsource = "a b"\ndest = "d::m"\n'
    m = manifest(spark, zipped(**{f"p/{release.MANIFEST_NAME}": f'[install]\nstyle_name = " s "\nvocab = ""\n{step}'}))["manifest"]
    assert (m["style_name"], m["vocab_name"], m["min_alert_level"]) == ("s", "s", "warning")
    assert list(m["post_sync_steps"]) == [f"uv run {release.TOOL} update-tengo-map --source 'a b' --dest d::m --type true"]
    for archive in (None, b"no zip", zipped(x="1"), zipped(**{release.MANIFEST_NAME: "not [toml"}), zipped(**{release.MANIFEST_NAME: "install = 3"})):
        m = manifest(spark, archive)["manifest"]
        assert (m["style_name"], m["vocab_name"], list(m["post_sync_steps"])) == ("dflt", "dflt", [])


@pytest.mark.parametrize(("body", "kind"), [("post_sync_steps = 3", TypeError), ("post_sync_steps = [1]", TypeError), ('post_sync_steps = [{action="x"}]', ValueError), ('post_sync_steps = [{action="update-tengo-map", source=1, dest="d"}]', TypeError), ('post_sync_steps = [{action="update-tengo-map", source="s", dest="d", type="z"}]', ValueError)])
def test_wrong_steps(spark, body, kind):
    archive = zipped(**{release.MANIFEST_NAME: f"[install]\n{body}\n"})
    assert manifest(spark, archive, False)["error"]
    with pytest.raises(kind):
        manifest(spark, archive)


@pytest.fixture
def project(tmp_path):
    (tmp_path / "styles/mine").mkdir(parents=True)
    (tmp_path / "styles/mine/Rule.yml").write_text("x: 1\n")
    (tmp_path / "styles/config/vocabularies/voc").mkdir(parents=True)
    (tmp_path / "styles/config/vocabularies/voc/accept.txt").write_text("a\n")
    return tmp_path


def test_package(spark, project):
    path = commands.package(spark, project, version="1.2")
    assert path.name == "mine-1.2.zip"
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == ["mine-1.2/.vale.ini", "mine-1.2/styles/mine/Rule.yml", "mine-1.2/styles/config/vocabularies/voc/accept.txt"]
        assert z.read("mine-1.2/.vale.ini") == b"StylesPath = styles\nVocab = voc\n"
    first = path.read_bytes()
    with pytest.raises(FileExistsError):
        commands.package(spark, project, version="1.2")
    assert commands.package(spark, project, version="1.2", force=True).read_bytes() == first


def test_package_choices(spark, project):
    (project / "styles/config/vocabularies/two").mkdir()
    (project / "pyproject.toml").write_text('[project]\nversion = " 3.0 "\n')
    (project / release.MANIFEST_NAME).write_text("[install]\n")
    path = commands.package(spark, project, ini_styles_path="custom")
    assert path.name == "mine-3.0.zip"
    with zipfile.ZipFile(path) as z:
        assert z.namelist()[:3] == ["mine-3.0/.vale.ini", f"mine-3.0/{release.MANIFEST_NAME}", "mine-3.0/custom/mine/Rule.yml"]
        assert z.read("mine-3.0/.vale.ini") == b"StylesPath = custom\n"
    with pytest.raises(FileNotFoundError, match="no1, no2"):
        commands.package(spark, project, styles=["no2", "mine", "no1"], version="4")
    with pytest.raises(ValueError):
        commands.package(spark, project, ini_styles_path="/abs", version="5")
    with pytest.raises(FileNotFoundError):
        commands.package(spark, project, styles_path="nowhere")


def test_update_map_command(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a=1\nb=2\na=3\n")
    (tmp_path / "s.tengo").write_text('m := {\n  "b": 2,\n}\n')
    assert commands.update_map(spark, "list.txt", "s.tengo::m", tmp_path, "=n") == "3 entries provided, 1 updated"
    assert (tmp_path / "s.tengo").read_text() == 'm := {\n  "b": 2,\n  "a": 3,\n}\n'
    for source, dest, mode in (("list.txt", "s.tengo", "=n"), ("list.txt", "::m", "=n"), ("list.txt", "list.txt", "=n"), ("list.txt", "s.tengo::m", "bad")):
        with pytest.raises(SystemExit):
            commands.update_map(spark, source, dest, tmp_path, mode)


def test_install_command(spark, tmp_path):
    archive = zipped(**{f"p/{release.MANIFEST_NAME}": '[install]\nmin_alert_level = "error"\n'})
    said = commands.install(spark, "o/sty-vale", tmp_path, fetch=lambda repo: release.payload_of("v7", "sty-7.zip"), download=lambda url: archive)
    assert said.startswith("Installed sty 7 from o/sty-vale into ")
    text = (tmp_path / ".vale.ini").read_text()
    assert "Packages = https://github.com/o/sty-vale/releases/download/v7/sty-7.zip\nMinAlertLevel = error\nVocab = sty\n" in text and "\t$(VALE) sync\n" in (tmp_path / "Makefile").read_text()


def test_sync_acronyms_command(spark, tmp_path):
    (tmp_path / "list").write_text("ab\n")
    (tmp_path / "s.tengo").write_text("allow := {\n}\n")
    assert "Updated 1 acronyms" in commands.sync_acronyms(spark, tmp_path / "list", tmp_path / "s.tengo")
    with pytest.raises(FileNotFoundError):
        commands.sync_acronyms(spark, tmp_path / "none", tmp_path / "s.tengo")


def test_paths(tmp_path):
    (tmp_path / "a.TENGO").write_text("x")
    assert sink.safe_resolve("a.TENGO", tmp_path, (".tengo",)).name == "a.TENGO"
    for bad, kind in ((" ", ValueError), ("/etc/passwd", ValueError), ("../x", ValueError), ("none", FileNotFoundError)):
        with pytest.raises(kind):
            sink.safe_resolve(bad, tmp_path)


def test_arguments():
    env = {"WEFTLINE_VERSION": "2", "WEFTLINE_STYLE": " a, ,b ", "WEFTLINE_RELEASE_TAG": "t", "WEFTLINE_INI_STYLES_PATH": "x"}
    z = cli.arguments(["zip", "--vocabulary", "v", "--force"], env)
    assert (z.archive_version, z.style_env, z.vocabulary, z.ini_styles_path, z.force, z.project_root) == ("2", ["a", "b"], "v", "x", True, ".")
    assert cli.arguments(["zip", "--style", "s", "--style", "t", "--archive-version", "3"], env).style == ["s", "t"]
    u = cli.arguments(["update-tengo-map", "--source", "l", "--dest", "d::m", "--type", "=n"], {})
    assert (u.source, u.dest, u.type) == ("l", "d::m", "=n") and cli.arguments(["update-tengo-map", "l", "d"], {}).type == "true"
    i = cli.arguments(["install", "o/r", "--release-version", "1"], env)
    assert (i.repo, i.release_version, i.tag, i.vale_ini) == ("o/r", "1", "t", ".vale.ini")
    for bad in (["update-tengo-map", "l"], ["install"], ["nothing"], []):
        with pytest.raises(SystemExit):
            cli.arguments(bad, {})


def test_command_line(spark, project):
    run = lambda *argv: cli.run(spark, cli.arguments([*argv, "--project-root", str(project)], {}))
    assert run("zip", "--archive-version", "1.2") == (0, str(project / "dist/mine-1.2.zip"))
    (project / "a list.txt").write_text("x=1\n")
    (project / "s.tengo").write_text("m := {\n}\n")
    assert run("update-tengo-map", "a list.txt", "s.tengo::m", "--type", "=n") == (0, "1 entries provided, 1 updated")
    assert run("update-tengo-map", "a list.txt", "s.tengo::none") == (1, "Could not find map 'none' in Tengo script.")
    assert run("sync-acronyms")[0] == 1
    script = project / commands.ACRONYM_SCRIPT
    script.parent.mkdir(parents=True)
    script.write_text("allow := {\n}\n")
    (project / ".config").mkdir()
    (project / commands.ACRONYM_LIST).write_text("ab\n")
    assert run("sync-acronyms") == (0, f"Updated 1 acronyms in {commands.ACRONYM_SCRIPT}.")


def test_network_messages():
    def fails(error):
        def opener(*_, **__):
            raise error

        return opener

    http, net = urllib.error.HTTPError("u", 404, "Not Found", {}, None), urllib.error.URLError("no route")
    for fetch, error, said in ((release.fetch_latest, http, "Failed to read latest release for o/r: Not Found"), (release.fetch_latest, net, "Network error talking to GitHub releases for o/r: no route"), (release.fetch_archive, http, "Failed to download archive https://o/r: Not Found"), (release.fetch_archive, net, "Network error downloading https://o/r: no route")):
        with pytest.raises(RuntimeError, match=said):
            fetch("https://o/r" if fetch is release.fetch_archive else "o/r", opener=fails(error))


def test_many_maps_in_one_job(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"l{i}.txt").write_text(f"a={i}\nb=1\n")
        (tmp_path / f"s{i}.tengo").write_text('m := {\n  "a": 1,\n}\n')
    got = commands.update_maps(spark, [(f"l{i}.txt", f"s{i}.tengo::m") for i in range(3)], tmp_path, "=n").collect()
    assert sorted((r["path"][-7:], r["provided"], r["updated"]) for r in got) == [("0.tengo", 2, 2), ("1.tengo", 2, 1), ("2.tengo", 2, 2)]
    assert (tmp_path / "s2.tengo").read_text() == 'm := {\n  "a": 2,\n  "b": 1,\n}\n'


def test_missing_files_are_named(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "path string")
    files = spark.createDataFrame([("a", "x")], TEXTS)
    assert {tuple(r) for r in with_missing(requests, files).collect()} == {("a", "x", False), ("b", None, True)}
    with pytest.raises(FileNotFoundError, match="b"):
        require(requests, files)


def test_vocabulary_and_ini_text(spark):
    assert spark.range(1).select(packaging.package_ini(F.lit("s"), F.lit("v"))).first()[0] == "StylesPath = s\nVocab = v\n"
