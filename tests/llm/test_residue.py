import pytest

from paperloom.llm import residue


@pytest.mark.parametrize("opened,closed", [("{{", "}}"), ("{{ ", " }}"), ("<%= ", " %>"), ("${", "}"), ("{", "}"), ("<", ">"), ("[", "]"), ("«", "»"), ("%%", "%%"), ("@@", "@@"), ("$$", "$$"), ("???", "???"), ("__", "__"), ("YOUR_", "_HERE")])
def test_placeholders_of_every_delimiter(opened, closed):
    text = f"# {opened}project_name{closed}\n\n{opened}DESCRIPTION{closed}\n\n## Usage\n\nWritten by {opened}author{closed}."
    assert residue.kinds_of(text) == ["placeholder"]


@pytest.mark.parametrize(
    "text,path",
    [
        ("# Set `TOKEN=YOUR_TOKEN_HERE`, then replace `<author>` and `<title>`; `{{ name }}` expands", "README.md"), ("{% for x in y %}\n# {{ project_name }} by {{ author }}\n{% endfor %}", "a.md"), ("# {{ project_name }} by {{ author }}", "templates/a.md.j2"),
        ("<html><head><title>x</title></head><p>{{ x.span }}</p><li>{{ x.title }}</li></html>", "a.html"), ("__version__ = '1'\n__author__ = 'x'", "a.py"), ("run: ${{ matrix.version }}", "a.yml"), ("a[title] = b[year]", "a.c"),
        ('def f(status):\n    pages = {404: "404 Not Found", 503: "Service Unavailable"}\n    return pages[status]', "a.py"), ('SAMPLE = "Lorem ipsum dolor sit amet"\nNOTICE = "Please enable JavaScript"\n\ndef f(x):\n    return x', "test_a.py"),
        ("<html><noscript>Charts need scripts; the table below works without.</noscript>" + "<p>real words of a page that say something of use</p>" * 12 + "</html>", "a.html"), ("if (x < 404) throw new Error(`y`);", "a.js"), ("", "a"), (None, "a"), (" \n", "a"),
    ],
)
def test_files_that_are_no_residue(text, path):
    assert residue.kinds_of(text, path) == []


@pytest.mark.parametrize("text", ["404: Not Found", '{"message": "Forbidden", "status": "403", "request": "x"}', "<html><head><title>502 Bad Gateway</title></head><body><h1>502 Bad Gateway</h1></body></html>", "<?xml version=\"1.0\"?><Error><Code>NotFound</Code><RequestId>r</RequestId></Error>", "Die Seite wurde nicht gefunden. Fehler 403.", "You have exceeded the download limit for this hour. Try again later.", "upstream connect error or disconnect before headers. reset reason: refused"])
def test_error_pages(text):
    assert residue.kinds_of(text) == ["error_page"]


@pytest.mark.parametrize("text", ["Please turn on JavaScript and cookies to continue.", "Checking your browser before the file is shown... scripts must be allowed (2535)", "Veuillez activer JavaScript pour afficher ce fichier", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "<body>Loading...<script src='/a.js'></script><p>JavaScript is required to browse the code.</p></body>"])
def test_script_notices(text):
    assert residue.kinds_of(text) == ["script_notice"]


CSS = "body { margin: 0; font: 16px/1.5 sans-serif; color: #333 }\n" * 90
JS = "window.load = function (x) { if (x === 404) { throw 'page not found' } };\n" * 90


@pytest.mark.parametrize(
    "text,kinds",
    [
        (f"<html><head><title>502 Bad Gateway</title><style>{CSS}</style></head><body><h1>502 Bad Gateway</h1></body></html>", ["error_page"]),
        (f"<HTML><STYLE type='text/css'>{CSS}</STYLE><!-- {CSS} > --><p>The page you asked for could not be found.</p></HTML>", ["error_page"]),
        (f"<body><script>{JS}</script ><p>Checking your browser before you go on.</p><script>{JS}</script></body>", ["script_notice"]),
        ("<img class='x' alt src=\"data:image/png;base64," + "iVBORw0KGgo/" * 400 + '"/><h1>Error 403</h1>', ["error_page"]),
        ("503 Service Unavailable" + " \n" * 3000, ["error_page"]),
        (f"<div>Loading</div><script>{JS}</script>", []),
        ("<p>Error 404 is what a server says.</p>" + "<p>real words of a page that say something of use</p>" * 60, []),
        ("404 not found where x <y " + "and more words stand, " * 200 + "z> 3", []),
        ('{"message":"Forbidden","items":[' + '{"a":1,"b":"c"},' * 400 + "0]}", []),
    ],
)
def test_long_markup_around_few_words(text, kinds):
    """What counts is what is seen, however much markup is around it."""
    assert len(text) > 2400 and residue.kinds_of(text) == kinds


@pytest.mark.parametrize("text", ["Title\n\n" + "Blah blah blah " * 9, "Title\n\n" + "Insert your paragraph here. " * 6, "x\n\nNisi lacus dolor vivamus sit congue lorem lorem vivamus. Amet tempor dolor blandit lacus.", "T\n\n" + "TEXT " * 20, "T\n\n" + "Hier steht ein Blindtext. " * 8])
def test_filler(text):
    assert residue.kinds_of(text) == ["filler"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "404: Not Found", "a", "x"), (1, "404: Not Found", "a", "x"), (2, "real text", "b", "x"), (3, None, None, "x")], "doc_id bigint, text string, path string, kind string")
    assert [tuple(r) for r in residue.find_residue(df).collect()] == [(1, "error_page")]
    assert sorted(r.doc_id for r in residue.without_residue(df).collect()) == [2, 3] and residue.find_residue(df.where("false").drop("path")).count() == 0


def test_density_decides_on_fields():
    prose = "This engine reads ledgers of many branches and balances them at the end of each day. " * 1400
    assert residue.kinds_of("{{project_name}} by {{author}}\n" + prose) == []
    assert residue.kinds_of("{{project_name}} by {{author}}\n" + prose[:1500]) == ["placeholder"]
    assert residue.kinds_of("# {{project_name}}") == ["placeholder"] and residue.kinds_of("# ${author}\n\n") == ["placeholder"]
    # a field alone in a text, and what a language writes so
    assert residue.kinds_of("# {{project_name}}\n" + prose[:300]) == [] and residue.kinds_of("<title>x</title>") == [] and residue.kinds_of("print(__name__)") == []


def test_lines_that_explain_fields_are_no_case():
    assert residue.kinds_of("Replace {{project_name}} with the name.\nFor example {{author}} becomes you.") == []
    assert residue.kinds_of("```\n{{project_name}} {{author}}\n```\nThe block above is `{{author}}`.") == []


def test_a_page_with_content_beside_its_notice_is_no_case():
    notice = "<noscript>Charts need scripts; the table below works without.</noscript>"
    assert residue.kinds_of(f"<html><body>{notice}<p>Loading</p></body></html>") == ["script_notice"]
    rows = "".join(f"<li>branch {i} sold much more grain than wool</li>" for i in range(5))
    assert residue.kinds_of(f"<html><body>{notice}<ul>{rows}</ul></body></html>") == []


def test_markup_of_any_length_is_not_seen():
    style = "<style>" + ".a{color:red}\n" * 400 + "</style>"
    assert residue.kinds_of(f"<html><head>{style}</head><body><h1>404 Not Found</h1></body></html>") == ["error_page"]
