"""Views derived from the ``documents`` table that look like repositories, drafts and responses.

Each view is one list of SQL expressions that both Spark and an ANSI engine
evaluate to the same rows, so a query and its check start from equal input and
grow with the table. All secrets are fake and joined from pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

BASE = [
    "doc_id", "text", "chr(10) AS nl", "chr(39) AS q", "chr(36) AS dl", "repeat(chr(96), 3) AS fence",
]


def _numbered(n: int) -> list[str]:
    return [*BASE, f"doc_id % {n} AS k", f"CAST(floor(doc_id / {n}) AS BIGINT) AS r"]


FILES = [
    "concat('repo_', CAST(r AS STRING)) AS repo",
    """split_part('README.md|pyproject.toml|requirements.txt|requirements-dev.txt|package.json|Makefile|.env.example|src/app/main.py|src/api/routes.py|src/web/Widget.tsx|src/web/util.js|tests/test_app.py|docs/guide.md|scripts/deploy.sh|.github/workflows/ci.yml|.github/CODEOWNERS|.github/dependabot.yml|.gitlab-ci.yml|Jenkinsfile|.circleci/config.yml|infra/main.tf|examples/demo.py|config/settings.json|package-lock.json', '|', CAST(k + 1 AS INT)) AS path""",
    """CASE k
    WHEN 0 THEN concat('# Repo ', CAST(r AS STRING), nl, nl, '| Metric | Value |', nl, '|---|---|', nl,
                       '| id | ', CAST(r AS STRING), ' |', nl, nl, fence, 'bash', nl, '# not a heading', nl, 'make test', nl, fence, nl,
                       '- first', nl, '1. one', nl, nl, nl, nl, nl, nl, text)
    WHEN 1 THEN concat('[project]', nl, 'name = "r', CAST(r AS STRING), '"', nl, 'dependencies = [', nl, '  "fastapi>=0.1",', nl, '  "click",', nl, ']', nl,
                       nl, '[project.scripts]', nl, 'tool', CAST(r AS STRING), ' = "app.cli:main"', nl)
    WHEN 2 THEN concat('# pins', nl, 'requests>=2.0', nl, 'numpy==1.', CAST(r % 5 AS STRING), nl, '-r other.txt', nl, 'uvicorn[standard]<1', nl)
    WHEN 3 THEN concat('pytest>=7', nl, 'ruff', nl)
    WHEN 4 THEN concat('{"main": "index.js", "bin": {"cli', CAST(r AS STRING), '": "bin/cli.js"}, "scripts": {"start": "node index.js", "test": "jest"}, ',
                       '"dependencies": {"react": "^18.', CAST(r % 3 AS STRING), '.0"}, "devDependencies": {"jest": "29.0.0"}}')
    WHEN 5 THEN concat('.PHONY: test', nl, 'install:', nl, chr(9), 'pip install .', nl, 'test: install', nl, chr(9), 'pytest', nl, 'lint:', nl, chr(9), 'ruff', nl)
    WHEN 6 THEN concat('# env', nl, 'DATABASE_URL=postgres', '://u:p', CAST(r AS STRING), '@db/x', nl, 'API_TOKEN=', nl, 'LOG_LEVEL=info', nl)
    WHEN 7 THEN concat('import os', nl, 'from app.core import x', nl, nl, 'class JobRunner(BaseRunner):', nl, '    \"\"\"Run jobs.\"\"\"', nl,
                       '    def method(self):', nl, '        pass', nl, nl, 'class DataLoader:', nl, '    pass', nl, nl,
                       'def get_user_name(self, user_id: int, flag=None):', nl, '    return os.getenv("USER_TABLE")', nl, nl,
                       'def main():', nl, '    \"\"\"Start it.\"\"\"', nl, '    os.environ["REGION_', CAST(r % 4 AS STRING), '"]', nl, '    # os.getenv("COMMENTED_OUT")', nl,
                       CASE WHEN r % 3 = 0 THEN concat('key = "AKIA', 'IOSFODNN7EXAMPLE"', nl) ELSE '' END,
                       CASE WHEN r % 5 = 0 THEN concat('ssn = "123', '-45-', '6789"', nl, '# patient ssn 123', '-45-', '6789', nl) ELSE '' END,
                       CASE WHEN r % 7 = 0 THEN concat('password = "', repeat('x', 12), '"', nl, '# password = "', repeat('y', 12), '"', nl) ELSE '' END, text)
    WHEN 8 THEN concat('@app.get("/items")', nl, 'def items():', nl, '    pass', nl, '@router.POST("/auth/', CAST(r % 3 AS STRING), '")', nl,
                       '@app.route("/legacy", methods=["GET", "put"])', nl,
                       CASE WHEN r % 4 = 0 THEN concat('card = 4111', repeat('1', 12), nl) ELSE '' END,
                       CASE WHEN r % 6 = 1 THEN concat('host = "10.0.0.', CAST(r % 200 AS STRING), '"', nl, '// host "192.168.1.1"', nl) ELSE '' END)
    WHEN 9 THEN concat('import React from "react"', nl, 'import {a} from "@scope/pkg/sub"', nl, '/**', nl, ' * Shows a widget.', nl, ' */', nl,
                       'export class WidgetView extends Base {}', nl, 'export interface WidgetProps {}', nl, 'type Id = string', nl)
    WHEN 10 THEN concat('export const loadPage = async (u) => 1', nl, 'function renderAll() {}', nl, 'const x = require("fs")', nl)
    WHEN 11 THEN concat('def test_one():', nl, '    mock_patient = 1', nl, text)
    WHEN 12 THEN concat('# Guide', nl, '## Repository Evidence', nl, 'raw', nl, '# Next', nl, 'Languages: {', q, 'Python', q, ': 3}', nl, text)
    WHEN 13 THEN concat('#!/bin/sh', nl, 'echo deploy', nl)
    WHEN 14 THEN concat('name: CI ', CAST(r AS STRING), nl, 'on:', nl, '  push:', nl, '    branches: [main, "develop", feature]', nl, '  pull_request:', nl, 'jobs:', nl,
                        '  build:', nl, '    environment: staging', nl, '    steps:', nl, '      - run: x ', dl, '{{ secrets.DEPLOY_KEY }}', nl, '  release:', nl,
                        '    environment: production', nl, '    steps:', nl, '      - run: y ', dl, '{{ secrets.NPM_TOKEN }} ', dl, '{{ secrets.DEPLOY_KEY }}', nl)
    WHEN 15 THEN concat('# owners', nl, '* @team-', CAST(r % 5 AS STRING), nl, '/docs/ @docs @writers', nl, 'orphan', nl)
    WHEN 16 THEN concat('version: 2', nl, 'updates:', nl, '  - package-ecosystem: "pip"', nl, '  - package-ecosystem: npm', nl, '  - package-ecosystem: "pip"', nl)
    WHEN 17 THEN concat('stages:', nl, '  - build', nl, '  - test', nl, 'variables:', nl, '  A: 1', nl, 'compile:', nl, '  script: echo ', dl, 'CI_TOKEN', nl, '  environment: prod', nl)
    WHEN 18 THEN concat('pipeline { stages { stage(', q, 'Build', q, ') {} stage("Ship") {} } ', 'x = credentials(', q, 'nexus', q, ') }', nl)
    WHEN 19 THEN concat('version: 2', nl, 'jobs:', nl, '  unit:', nl, '    docker: x', nl, '  e2e:', nl, '    docker: y', nl)
    WHEN 20 THEN concat('resource "aws_vpc" "v" {', nl, '  cidr = "10.', CAST(r % 200 AS STRING), '.0.0"', nl, '}', nl)
    WHEN 21 THEN concat('import requests', nl, 'print(requests.get("http://x"))', nl)
    WHEN 22 THEN '{"debug": true}'
    ELSE concat('{"k": "AKIA', 'IOSFODNN7EXAMPLE"}') END AS content""",
]

# A second shape of repository: hosting settings, charts, Poetry, doc comments, ignored and unscannable files.
HOST_FILES = [
    "concat('host_', CAST(r AS STRING)) AS repo",
    """CASE WHEN k = 0 AND r % 4 = 1 THEN 'node_modules/x/README.md'
      WHEN k = 1 AND r % 2 = 0 THEN '.github/FUNDING.yml'
      WHEN k = 4 AND r % 3 = 0 THEN '.github/ISSUE_TEMPLATE.md'
      WHEN k = 5 AND r % 2 = 0 THEN '.github/PULL_REQUEST_TEMPLATE.md'
      WHEN k = 5 AND r % 5 = 1 THEN '.github/notes.md'
      WHEN k = 6 AND r % 3 = 0 THEN '.github/release-drafter.yml'
      WHEN k = 10 AND r % 2 = 0 THEN '.github/workflows/release.yml'
      WHEN k = 16 AND r % 2 = 0 THEN 'build/out.py'
      ELSE split_part('README.md|.github/FUNDING.yaml|.github/labels.yml|.github/ISSUE_TEMPLATE/bug.md|.github/ISSUE_TEMPLATE/feature.yml|.github/pull_request_template.md|.github/other.yml|.github/actions/setup/action.yml|.github/actions/lint/action.yaml|.github/workflows/reuse.yaml|.github/workflows/ship.yml|.github/workflows/simple.yml|.github/dependabot.yaml|pyproject.toml|src/pkg/__main__.py|src/models/types.ts|docs/img.PNG|charts/app/Chart.yaml|playbooks/site.yml|Dockerfile|src/base/handlers.py|cloudformation/stack.template|docs/api_schema.rst|.env', '|', CAST(k + 1 AS INT)) END AS path""",
    """CASE k
    WHEN 1 THEN concat('github: [a', CAST(r AS STRING), ']', nl, 'patreon: x', nl, 'custom: ["u"]', nl)
    WHEN 2 THEN concat('- name: bug', nl, '  color: f00', nl, '- name: "help wanted', CAST(r % 3 AS STRING), '"', nl)
    WHEN 9 THEN concat('on:', nl, '  workflow_call:', nl, 'jobs:', nl, '  call_', CAST(r % 6 AS STRING), ':', nl, '    runs-on: x', nl)
    WHEN 10 THEN concat('on: [push, workflow_dispatch]', nl, 'jobs:', nl, '  ship:', nl, '    runs: ', CASE WHEN r % 3 = 0 THEN 'semantic-release' ELSE 'echo' END, nl,
                        'env:', nl, '  X: ', dl, '{{secrets.KEY_2}}', nl)
    WHEN 11 THEN concat('name: ', q, 'Simple ', CAST(r AS STRING), q, nl, 'on: push', nl, 'jobs:', nl, '  only:', nl, '    branches: [master, release/*, x]', nl)
    WHEN 12 THEN concat('updates:', nl, '  - package-ecosystem: docker', nl, '  - package-ecosystem: ', q, 'github-actions', q, nl)
    WHEN 13 THEN concat('[tool.poetry]', nl, 'name = "h"', nl, '[tool.poetry.dependencies]', nl, 'python = "^3.10"', nl, 'Django = "^4.', CAST(r % 4 AS STRING), '"', nl,
                        '# note = 1', nl, 'boto3 = {version = "1"}', nl, nl, '[tool.poetry.group.dev.dependencies]', nl, 'black = "*"', nl,
                        '[tool.poetry.scripts]', nl, 'run', CAST(r AS STRING), ' = ', q, 'h.cli:go', q, nl, '[build-system]', nl, 'requires = ["poetry-core"]', nl)
    WHEN 14 THEN concat('from .core import go', nl, 'import _thread, sys', nl, 'import a.b.c', nl, 'from a.z import q', nl, 'import os', nl,
                        'v = os.environ.get("HOST_', CAST(r % 3 AS STRING), '") or os.getenv("LOWER_x") or os.getenv(', q, 'ALPHA', q, ')', nl, 'go(', q, text, q, ')', nl)
    WHEN 15 THEN concat('/** The type Shape', CAST(r AS STRING), ' here. */', nl, 'export type Shape = string', nl, '/**', nl, ' * @internal', nl, ' * Holds rows.', nl, ' */', nl,
                        'export default class RowStore extends BaseStore {}', nl, '/** Loads it. */', nl, 'export async function loadRows(a) {}', nl,
                        'export const loadRows = (a) => 1', nl, 'class abstractThing {}', nl, 'class AbstractThing {}', nl, '/** far */', nl, 'let z = 1', nl, 'class QueryBuilder {}', nl,
                        'interface RowStore {}', nl, 'interface Row_Shape {}', nl, 'let onClick = (e) => e', nl, 'import x from ', q, 'lodash/fp', q, nl, 'import y from "lodash"', nl)
    WHEN 17 THEN concat('name: app', nl, 'version: ', CAST(r AS STRING), nl)
    WHEN 20 THEN concat('class HTTPHandler(BaseHandler, Mixin):', nl, '    pass', nl, 'class BaseThing:', nl, 'class User_Model(BaseModel):', nl, '    x = 1', nl,
                        'class Money(Decimal):', nl, '    ', q, q, q, nl, '    Exact money.', nl, '    Second line.', nl, '    ', q, q, q, nl, 'class Plain:', nl, '    y = 2', nl,
                        'def to_dict(self, a: Dict[str, int] = None, *args, b = 2) -> dict:', nl, '    return {}', nl, 'def xylophone():', nl, '    pass', nl,
                        'async def hidden():', nl, '    pass', nl, 'def _private_get(cls):', nl, '    pass', nl, 'def is_ready_', CAST(r AS STRING), '():', nl, '    \"\"\"Ready?\"\"\"', nl,
                        'token = "', repeat('t', 20), '"', nl)
    WHEN 23 THEN concat('SECRET=1', nl)
    ELSE concat('file ', CAST(k AS STRING), nl, text, nl) END AS content""",
]

# Markdown drafts with the cases the block parser and the clean-up have to get right.
DRAFTS = [
    "doc_id",
    """concat(
    CASE WHEN k IN (0, 5) THEN concat(fence, 'sh', nl, '# inside fence', nl, '| no | table |', nl, fence, nl) ELSE '' END,
    '# Title ', CAST(r AS STRING), nl, nl, 'Some **bold', CAST(k AS STRING), '** and `code` text **x', nl,
    CASE k
    WHEN 0 THEN concat('# CI/CD WORKFLOWS', nl, 'drop me', nl, '## sub', nl, 'me too', nl, '# KEY FILE CONTENTS', nl, fence, nl, '# still code', nl, fence, nl, 'gone', nl, '# Kept', nl)
    WHEN 1 THEN concat('## Repository Evidence and more', nl, 'raw ', CAST(r AS STRING), nl, '### Deep', nl, 'stays', nl, '# repository evidence', nl, 'gone', nl, '## After', nl)
    WHEN 2 THEN concat(fence, 'json', nl, '{', repeat('"a": 1, ', 80), nl, '}', nl, fence, nl, fence, 'json', nl, '{"b": 2}', nl, fence, nl)
    WHEN 3 THEN concat('  Languages: {', q, 'Python', q, ': 3}  ', nl, 'Categories: {', q, 'x', q, ': 1}', nl, 'Tools: [', q, 'npm', q, ']', nl, '   Purpose: Test files', nl, 'Purpose: other things here', nl)
    WHEN 4 THEN concat('## src/app/ (10 files)', nl, '   Purpose: Source code', nl, '   Languages: x', nl, '## lib/ (1 file)', nl, 'Not a dump', nl, '## pkg_a/b/ (2 files)', nl, '  Purpose: y', nl, '# Top', nl)
    WHEN 5 THEN concat('## Terraform', nl, 'This is not applicable here.', nl, '## Helm charts', nl, 'Used daily.', nl, '# Kubernetes', nl, 'N/A', nl, '## Ansible roles', nl, 'no ansible', nl, '### Next', nl, 'ok', nl)
    WHEN 6 THEN concat('| Name | `Cell` |', nl, '|---|---|', nl, '| a', CAST(r AS STRING), ' | `b` | extra |', nl, '| c |', nl, fence, nl, '| code | row |', nl, fence, nl, '| T2 | U2 |', nl, '|:--|--:|', nl, '| 1 | 2 |', nl)
    ELSE concat('- one', nl, '* two', nl, '  - three', nl, '  * four', nl, '1. first', nl, '12. twelfth', nl, '1 no', nl, '#### Four', nl, '##### Five', nl, nl, nl, nl, nl, nl, nl) END,
    CASE WHEN k = 7 THEN concat('| end | table |', nl, '| x | y |') ELSE text END,
    CASE WHEN k IN (2, 6) THEN concat(nl, fence, nl, '## open fence to the end') ELSE '' END, nl, nl) AS body""",
]

# Answers of a text service: labelled lines, section bodies, some missing or null.
RESPONSES = [
    "concat('repo_', CAST(r AS STRING)) AS repo",
    """CASE k % 3 WHEN 0 THEN 'repository-overview' WHEN 1 THEN 'architecture-guide' ELSE 'quality-and-validation' END AS doc_type""",
    "CAST(floor(k / 3) + 1 AS BIGINT) AS section_ord",
    """CASE WHEN k = 4 THEN NULL ELSE concat(
    '## Section ', CAST(k AS STRING), nl, 'PURPOSE: Keeps rows ', CAST(r AS STRING), nl, '  ARCHITECTURE: layers, PURPOSE: twice ', nl,
    CASE WHEN k % 2 = 0 THEN concat('CONCEPTS: spark, , joins ,windows', nl) ELSE '' END,
    CASE WHEN k = 3 THEN concat('CONCEPTS: last one wins', nl, 'PURPOSE: Second', nl) ELSE '' END, text) END AS body""",
]

# One example line per pattern.
PATTERN_LINES = [
    "concat('id 123','-45-','6789')", "concat('12345','6789 is my ssn')", "concat('mrn: AB','123456')", "concat('4111',repeat('1',12))",
    "concat('account_number = ',repeat('7',10))", "concat('AK','IA',repeat('Z',16))", "concat('aws_secret_access_key = \"',repeat('a',40),'\"')",
    "concat('AI','za',repeat('b',35))", "concat('\"type\": \"service','_account\"')",
    "concat('DefaultEndpointsProtocol=https;AccountName=n;Account','Key=',repeat('A',88))", "concat('sv=2020-01-01&ss=b&si','g=abc')",
    "concat('api_key = \"',repeat('k',24),'\"')", "concat('\"Bea','rer aaa.bbb.ccc\"')", "concat('-----BEGIN RSA PRIV','ATE KEY-----')",
    "concat('-----BEGIN PRIV','ATE KEY-----')", "concat('-----BEGIN ENCRYPTED PRIV','ATE KEY-----')", "concat('gh','p_',repeat('x',36))",
    "concat('gh','o_',repeat('x',36))", "concat('glp','at-',repeat('x',20))", "concat('xo','xb-',repeat('1',10),'-',repeat('2',10),'-',repeat('z',24))",
    "concat('https://hooks.sl','ack.com/services/T',repeat('A',8),'/B',repeat('B',8),'/',repeat('c',24))", "concat('postgres','://u:p@h/x')",
    "concat('mysql','://u:p@h/x')", "concat('mongodb+srv','://u:p@h/x')", "concat('redis','://:p@h/0')", "concat('amqps','://u:p@h/x')",
    "concat('sk_','live_',repeat('0',24))", "concat('rk_','live_',repeat('0',24))", "concat('paypal_client_id = \"',repeat('q',20),'\"')",
    "concat('S','K',repeat('0',32))", "concat('S','G.',repeat('a',22),'.',repeat('b',43))", "concat('ke','y-',repeat('0',32))",
    "concat('s','k-',repeat('p',32))", "concat('sk','-ant-',repeat('q',40))", "concat('h','f_',repeat('r',34))", "'patient_name = x'",
    "'\"diagnosis\": 1'", "'dob = 01/02/1990'", "concat('pass','word = \"',repeat('x',8),'\"')", "concat('tok','en = \"',repeat('x',16),'\"')",
    "concat('authorization: \"Bas','ic ',repeat('c',20),'\"')", "concat('aes_key = \"',repeat('0',32),'\"')", "concat('iv = \"',repeat('0',16),'\"')",
    "concat('ssh_pass = \"','zz\"')", "'h = \"10.1.2.3\"'", "concat('-----BEGIN CERT','IFICATE-----')", "concat('http://h/p?api_key=',repeat('y',16))",
    "concat('session_token = \"',repeat('t',100),'\"')",
    "concat('api_key = \"',repeat('a',8),'-',repeat('b',4),'-',repeat('c',4),'-',repeat('d',4),'-',repeat('e',12),'\"')",
    "concat('do_token = \"',repeat('f',64),'\"')", "'# patient info'", "'email = x'", "'mock_patient'", "concat('ey','Ja.ey','Jb.c')",
    "'use bcrypt here'", "'see HIPAA'", "'audit_log on'",
]

# Each document followed by one example line: long lines carry it past or across the 100th character.
PLANTED = [
    "doc_id",
    "concat(text, nl, CASE WHEN r % 4 = 0 THEN repeat('pad ', 22) WHEN r % 4 = 1 THEN repeat('pad ', 30) ELSE '' END, CASE k "
    + " ".join(f"WHEN {i} THEN {line}" for i, line in enumerate(PATTERN_LINES))
    + " END, CASE WHEN r % 4 = 3 THEN concat(' ', repeat('end ', 9)) ELSE '' END, nl) AS content",
]

# Workflow files in the forms that YAML allows: wide indents, lists at the margin, flow maps, quoted keys, maps as environments.
WORKFLOW_FORMS = [
    "doc_id",
    """CASE k
    WHEN 0 THEN concat('name: CI ', CAST(r AS STRING), nl, 'on:', nl, '    push:', nl, '        branches: [main]', nl, '    pull_request:', nl, 'jobs:', nl, '    build:', nl,
                       '        environment: staging', nl, '        steps:', nl, '            - run: |', nl, '                environment: fake', nl, '    ship', CAST(r AS STRING), ':', nl,
                       '        environment:', nl, '            url: http://x', nl, '            name: "prod-', CAST(r % 3 AS STRING), '"', nl)
    WHEN 1 THEN concat('# ', replace(text, nl, ' '), nl, 'name: "A: b', CAST(r AS STRING), '"  # note', nl, 'on: [push, ', q, 'workflow_dispatch', q, ']', nl, 'jobs:', nl, '  deploy:', nl,
                       '    runs-on: x', nl, '    environment: {name: live', CAST(r AS STRING), ', url: "http://h:1/a,b"}', nl)
    WHEN 2 THEN concat('"on":', nl, '  - push', nl, '  - "schedule"', nl, 'jobs: {lint: {runs-on: x, steps: [{run: "a, b"}], environment: test}, build', CAST(r AS STRING),
                       ': {environment: {name: live}}, none: }', nl)
    WHEN 3 THEN concat('on:', nl, '- push', nl, '- release # x', nl, 'env: {A: 1}', nl, 'jobs:', nl, '  a: {runs-on: x, environment: qa', CAST(r AS STRING), '}', nl, '  "b c":', nl, '   runs-on: y', nl)
    WHEN 4 THEN concat('---', nl, 'on: {push: {branches: [a]}, release: }', nl, 'jobs:', nl, nl, '      only:  # wide', nl, '        environment: ', q, 'e ', CAST(r AS STRING), q, nl, chr(9), nl)
    ELSE text END AS content""",
]

# Project files whose lists hold extras, markers, comments and brackets, on one line or several.
PROJECT_FORMS = [
    "doc_id",
    """CASE k
    WHEN 0 THEN concat('[project]', nl, 'dependencies = ["uvicorn[standard]>=0.2",', nl, '  "click', CAST(r AS STRING), '>=8", # not ] "this"', nl, '  ', q, 'rich', q, ', "x; python_version < ', q, '3', q, '"]', nl, 'name = "z"', nl)
    WHEN 1 THEN concat('dependencies = ["a[b]", "c', CAST(r AS STRING), '"]', nl, 'other = ["d"]', nl, text, nl)
    WHEN 2 THEN concat('[project.optional-dependencies]', nl, 'dev-dependencies = [', nl, '  "pytest[cov]",  # "gone"', nl, '  # "commented"', nl, '  "dev-dependencies-', CAST(r AS STRING), '",', nl, ']', nl, '"after"', nl)
    ELSE concat('[tool.poetry.dependencies]', nl, 'python = "^3"', nl, 'Django = "4"', nl, 'boto', CAST(r AS STRING), ' = {version = "1", extras = ["s3"]}', nl, '[x]', nl, 'y = 1', nl) END AS content""",
]

VIEWS = {
    "workflow_forms": (6, WORKFLOW_FORMS),
    "project_forms": (4, PROJECT_FORMS),
    "files": (24, FILES),
    "host_files": (24, HOST_FILES),
    "drafts": (8, DRAFTS),
    "responses": (12, RESPONSES),
    "planted": (len(PATTERN_LINES), PLANTED),
}


def sample_view(documents: DataFrame, name: str) -> DataFrame:
    """The named view over a ``documents`` table; file views get ``size_bytes`` as well."""
    n, expressions = VIEWS[name]
    view = documents.selectExpr(*_numbered(n)).selectExpr(*expressions)
    return view.selectExpr("*", "CAST(octet_length(content) AS BIGINT) AS size_bytes") if "files" in name else view


def sample_sql(name: str) -> str:
    """The same view as the body of a common table expression in ANSI SQL."""
    n, expressions = VIEWS[name]
    size = ", octet_length(encode(content)) AS size_bytes" if "files" in name else ""
    return (
        f"SELECT *{size} FROM (SELECT {', '.join(expressions)} FROM (SELECT {', '.join(_numbered(n))} FROM documents))"
    )
