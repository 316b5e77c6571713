"""Programs in forked children: the three standard streams, harnesses, limits, order and speed."""

import os
import subprocess
import sys
import time

from pyspark.sql import functions as F

from tracemill.operators import execution as ex

CALL = {"type": "call", "fn_name": "f", "input": "3", "output": "4"}
F_ = "def f(x):\n    return x + 1\n"


def test_what_a_program_prints_or_reads_is_not_the_answer():
    assert ex.plus_asserts("f", "print('noise')\nprint('{}')\n" + F_, "[[1], [2]]") == ["assert f(1) == 2", "assert f(2) == 3"]
    for head in ("print('noise')\n", "import sys\nx = sys.stdin.read()\n", "import sys\nprint(list(sys.stdin))\n", "import os\nos.write(1, b'[1, 2]')\n", "import os\nfor fd in range(3, 20):\n    try:\n        os.write(fd, b'x' * 9)\n    except OSError:\n        pass\n"):
        assert ex.passes_case(head + F_, CALL) and not ex.passes_case(head + F_.replace("1", "2"), CALL), head
    assert not ex.passes_case("import sys\nsys.exit(3)\n" + F_, CALL) and not ex.passes_case("def g(): pass", CALL)


def test_programs_that_print_much():
    big = "print('\\n'.join(str(k) for k in range(300000)))"
    want = "\n".join(map(str, range(300_000)))
    assert len(want) > 1_900_000 and ex.passes_case(big, {"input": "", "output": want}) and not ex.passes_case(big, {"input": "", "output": want + "1"})
    assert ex.passes_test("print('x' * 3_000_000)\n" + F_, "assert f(1) == 2")
    assert ex.run_program("while True:\n    print('x' * 10000)", timeout=20, most=1 << 20)[:2] == (False, "")


def test_programs_end_like_any_other():
    ends = {"raise SystemExit": True, "raise SystemExit(0)": True, "raise SystemExit('no')": False, "exit(1)": False, "1/0": False, "import os; os._exit(0)": True, "def (": False}
    assert {s: ex.run_program(s)[0] for s in ends} == ends
    late = "import atexit, threading, time\natexit.register(lambda: print('bye'))\nthreading.Thread(target=lambda: (time.sleep(.2), print('late'))).start()\nprint('first')"
    assert ex.run_program(late)[:2] == (True, "first\nlate\nbye\n")
    assert ex.run_program("import sys\nassert __name__ == '__main__' and sys.modules['__main__'].__dict__ is globals()\nclass A: pass\nimport pickle\nprint(type(pickle.loads(pickle.dumps(A()))).__name__)")[:2] == (True, "A\n")
    assert ex.run_program("import os\nprint(sorted(os.environ), os.listdir('.'))")[1] in ("['LANG', 'PATH'] []\n", "['LANG', 'LC_CTYPE', 'PATH'] []\n")
    # a program leaves nothing to the next one of its server
    assert ex.run_program("import builtins, math\nbuiltins.x = 1\nmath.pi = 3")[0] and ex.run_program("import math\nassert math.pi > 3.1\ntry:\n    x\nexcept NameError:\n    print('none')")[1] == "none\n"


def test_limits_and_servers_that_end():
    began = time.monotonic()
    assert not ex.run_program("while True: pass", timeout=1)[0] and not ex.run_program("import time\ntime.sleep(60)", timeout=1)[0] and time.monotonic() - began < 10
    assert not ex.run_program("x = bytearray(3 << 30)")[0] and ex.run_program("print('ü')")[1] == "ü\n"
    spawned = "import subprocess, sys\np = subprocess.Popen(['sleep', '300'])\nprint(p.pid)"
    pid = int(ex.run_program(spawned)[1])
    time.sleep(0.2)
    assert not os.path.exists(f"/proc/{pid}") or open(f"/proc/{pid}/stat").read().split()[2] == "Z"
    assert not ex.run_program("import os, signal\nos.kill(os.getppid(), signal.SIGKILL)\nimport time\ntime.sleep(5)")[0]  # the server too
    assert ex.run_program("print(1)")[:2] == (True, "1\n")


def test_ten_times_the_tests_a_second():
    def rate(run, n):
        began = time.monotonic()
        for _ in range(n):
            run()
        return n / (time.monotonic() - began)

    ex.run_program("")
    program = "import json, collections, itertools, heapq, random, typing, re, math\n" + F_ + "assert f(1) == 2"
    forked = rate(lambda: ex.run_program(program), 60)
    started = rate(lambda: subprocess.run([sys.executable, "-I", "-c", program], check=True), 6)
    print(f"\n{forked:.0f} tests a second against {started:.0f}")
    assert forked > 4 * started  # 10 times on an idle machine


def test_order_of_rows_is_kept_and_the_functions_run_once(spark):
    rows = spark.range(60).select("id", F.concat(F.lit("def f(x):\n    return x + "), F.col("id") % 3, F.lit("\nprint('noise')")).alias("code"), F.lit("assert f(1) == 2").alias("test")).repartition(3)
    df = rows.withColumn("ok", ex.test_udf()("code", "test"))
    assert {r.id: r.ok for r in df.collect()} == {k: k % 3 == 1 for k in range(60)}
    plan = df.where("ok").where("id > 5").select("id", "ok", F.expr("not ok").alias("no"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
