"""Two small source trees as tables, for the tests of operators that read source code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "app/main.py": "from fastapi import FastAPI\nfrom app.api import users\n\napp = FastAPI()\napp.include_router(users.router, prefix='/v1')\n",
    "app/api/__init__.py": "x = 1\n",
    "app/api/users.py": (
        "from fastapi import APIRouter, Depends\nfrom ..services.user import load_user\nfrom app.models import User\n\nrouter = APIRouter(prefix='/users')\n\n\n"
        "@router.get('/{id}')\nasync def read(id: int, me=Depends(get_current_user)):\n    if id and me:\n        return load_user(id)\n    return [x for x in range(3) if x]\n\n\n"
        "@router.post('')\ndef create(name):\n    return load_user(name)\n"
    ),
    "app/services/__init__.py": "y = 2\n",
    "app/services/user.py": "from app.models import User\n\n\ndef load_user(id):\n    return fetch(id)\n\n\ndef fetch(id):\n    return session.query(User)\n",
    "app/models.py": (
        "class User(Base):\n    __tablename__ = 'people'\n    id = Column(Integer)\n    team = relationship('Team')\n\n\n"
        "class Team(Base):\n    __tablename__ = 'teams'\n    id = Column(Integer)\n    users = relationship('people')\n\n\nLIMIT = 3\n"
    ),
    "app/util/left.py": "from app.util.right import b\n\n\ndef a():\n    return b()\n",
    "app/util/right.py": "from .left import a\n\n\ndef b():\n    for _ in a():\n        while b:\n            pass\n    db_password = 'correct horse battery'\n",
    "tests/test_user.py": "from app.services.user import load_user\n\n\ndef test_load_user():\n    load_user(1)\n",
    "bad.py": "def broken(:\n",
    "web/app/(shop)/items/[id]/page.tsx": "import { a } from '@/lib/api'\nimport x from '../../helper'\nexport const Page = async () => a\n",
    "web/app/(shop)/helper.ts": "// TODO: name it well\nexport function helper() {}\n",
    "web/src/lib/api.ts": "const express = require('express')\napp.get('/items', list)\n",
    "web/tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"],}, },\n}',
    "svc/Shop.java": 'import java.util.List;\n\n@RestController\npublic class Shop {\n  @GetMapping("/shop")\n  public List<String> all() { return null; }\n}\n',
    "svc/main.go": 'package main\n\nfunc Serve() {\n\tr.GET("/ping", ping)\n}\n',
    "shop/urls.py": "from django.urls import include, path\n\nurlpatterns = [\n    path('items/<int:pk>/', views.item, name='item'),\n    re_path(r'^old/$', views.old),\n    path('api/', include('shop.api.urls')),\n]\n",
    "alembic/versions/1_start.py": "def upgrade():\n    op.create_table('people')\n    op.create_table('audit')\n    op.add_column('people', 'x')\n",
    "db/migrate/2.sql": "CREATE TABLE IF NOT EXISTS log (id int);\nALTER TABLE log ADD y int;\n",
    "web/src/cats.controller.ts": "@Controller('cats')\nexport class Cats {\n  @Get(':id')\n  one() { return prisma.cat.findMany() }\n  @Post()\n  add() {}\n}\n@Entity()\nexport class Cat {}\napp.use('/admin', adminRouter)\n",
    "requirements.txt": "# all\nfastapi==0.1\nuvicorn[standard]>=2 ; python_version > '3'\n-r other.txt\nplain\n",
    "pyproject.toml": "[project]\ndependencies = ['httpx>=0.2', 'rich']\n[tool.poetry.dependencies]\npython = '^3'\nattrs = '^1'\n",
    "package.json": '{"name": "w", "dependencies": {"react": "^18"}, "devDependencies": {"vite": "5"}}',
    "go.mod": "module example.com/m\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
}

#: A second tree: modules of several languages, and endpoints with queries and tasks behind them.
MORE = {
    "go.mod": "module example.com/m\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"example.com/m/internal/store"\n\t"github.com/gin-gonic/gin"\n)\n',
    "internal/store/a.go": "package store\n\nfunc Open() {}\n",
    "internal/store/a_test.go": "package store\n",
    "j/App.java": "import com.shop.Cart;\nimport org.springframework.boot.Run;\n\nclass App {}\n",
    "j/com/shop/Cart.java": "class Cart {}\n",
    "rb/app.rb": "require 'app/auth'\nrequire_relative 'lib/x'\nrequire 'json'\n",
    "rb/lib/x.rb": "class X\nend\n",
    "rb/app/auth.rb": "def sign\nend\n",
    "php/index.php": "<?php\nuse App\\Models\\Item;\nuse Model\\Price;\nuse Illuminate\\Http\\Request;\n",
    "app/Model/Price.php": "<?php\nclass Price {}\n",
    "old/Item.php": "<?php\nclass Item {}\n",
    "src/lib.rs": "use crate::net::http;\nuse serde::Serialize;\n\npub fn go() {}\n",
    "src/net/http.rs": "pub fn get() {}\n",
    "c/main.c": '#include "../inc/a.h"\n#include "b.h"\n#include <stdio.h>\n\nint main(void) {\n  return 0;\n}\n',
    "inc/a.h": "int a(void);\n",
    "z/b.h": "int b(void);\n",
    "api/login.py": (
        "from fastapi import APIRouter, Depends\nfrom services.accounts import find, remember\n\nrouter = APIRouter()\n\n\n"
        "@router.post('/login')\ndef login(name, me=Depends(current_user)):\n    user = find(name)\n    remember(user)\n    return helper(user)\n\n\n"
        "def helper(user):\n    return user\n\n\n@router.get('/ping')\ndef ping():\n    return 'pong'\n"
    ),
    "services/accounts.py": (
        "from repositories.people import row_of\n\n\ndef find(name):\n    \"\"\"A person by name.\"\"\"\n    return row_of(name)\n\n\n"
        "def remember(user):\n    session.add(user)\n    db.execute('UPDATE people SET seen = 1')\n"
    ),
    "repositories/people.py": "def row_of(name) -> dict:\n    return Person.objects.filter(name=name)\n",
    "jobs/mail.py": "from celery import shared_task\n\n\n@shared_task\ndef send(to):\n    return to\n\n\ndef task_clean():\n    return 1\n\n\ndef other():\n    return 2\n",
    "web/store.ts": "import React, { createContext } from 'react'\nexport const Theme = createContext(null)\nconst LIMITS = { a: 1 }\nexport class Cart {\n  private total(x: number): number {\n    if (x) {\n      return x\n    }\n  }\n}\n",
}


def files(spark: SparkSession, tree: dict[str, str] = FILES) -> DataFrame:
    """Rows (path, text, size, reason) as corpus.read_tree gives them."""
    return spark.createDataFrame([(k, v, len(v.encode()), None) for k, v in tree.items()], "path string, text string, size long, reason string")
