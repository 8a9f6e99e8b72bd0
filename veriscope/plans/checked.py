"""Rows of queries over literal programs, checked by hand: columns with their types in SQL, and the rows."""

CHECKED: dict[str, tuple[str, list[tuple]]] = {
    'x01_random': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def vmykotgieup(ifnfehsgrfq):\n    total = 0\n    for x in ifnfehsgrfq:\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def hgboxpopqrzspk(ftdjvwwgwfwgw):\n    out = []\n    for i in range(ftdjvwwgwfwgw):\n        out.append(i * 4)\n    return out'),
            ('logic', 'ok', None, 'def ffflttheamfync(dqtulzpxr, xnnnrydzvvd):\n    if dqtulzpxr and (not xnnnrydzvvd) or dqtulzpxr > 10:\n        return True\n    return False'),
            ('text', 'ok', None, 'def jxaauef(dgjeckcpub):\n    return dgjeckcpub + "it\'s"'),
            ('nested', 'ok', None, 'def ftdjvwwgwfwgw(lpfkozxfnm):\n    out = 0\n    for row in lpfkozxfnm:\n        for v in row:\n            out += v * 7\n    return out'),
            ('zip', 'ok', None, 'def tzixswiknllh(dqtulzpxr, xnnnrydzvvd):\n    return [x for x, y in zip(dqtulzpxr, xnnnrydzvvd)]'),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'ok', None, 'def fpbzebhb(lnlniuhaclpn):\n    return 1 / lnlniuhaclpn'),
        ],
    ),
    'x02_sequential': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def generic_function1(var1):\n    total = 0\n    for x in var1:\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def generic_function1(var1):\n    out = []\n    for i in range(var1):\n        out.append(i * 4)\n    return out'),
            ('logic', 'ok', None, 'def generic_function1(var1, var2):\n    if var1 and (not var2) or var1 > 10:\n        return True\n    return False'),
            ('text', 'ok', None, 'def generic_function1(var1):\n    return var1 + "it\'s"'),
            ('nested', 'ok', None, 'def generic_function1(var1):\n    out = 0\n    for row in var1:\n        for v in row:\n            out += v * 7\n    return out'),
            ('zip', 'ok', None, 'def generic_function1(var1, var2):\n    return [x for x, y in zip(var1, var2)]'),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'ok', None, 'def generic_function1(var1):\n    return 1 / var1'),
        ],
    ),
    'x03_literal_format': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'error', 'IdenticalMutationError > the text did not change', None),
            ('range', 'error', 'IdenticalMutationError > the text did not change', None),
            ('logic', 'error', 'IdenticalMutationError > the text did not change', None),
            ('text', 'ok', None, 'def t(s):\n    return s + \'it"s\''),
            ('nested', 'error', 'IdenticalMutationError > the text did not change', None),
            ('zip', 'error', 'IdenticalMutationError > the text did not change', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'IdenticalMutationError > the text did not change', None),
        ],
    ),
    'x04_for2enumerate': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def f(xs):\n    total = 0\n    for loop_var, x in enumerate(xs):\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def g(n):\n    out = []\n    for loop_var, i in enumerate(range(n)):\n        out.append(i * 4)\n    return out'),
            ('logic', 'error', 'NoForLoopError > nothing to rewrite', None),
            ('text', 'error', 'NoForLoopError > nothing to rewrite', None),
            ('nested', 'ok', None, 'def n(m):\n    out = 0\n    for loop_var1, row in enumerate(m):\n        for loop_var, v in enumerate(row):\n            out += v * 7\n    return out'),
            ('zip', 'error', 'NoForLoopError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoForLoopError > nothing to rewrite', None),
        ],
    ),
    'x05_for2while': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def f(xs):\n    total = 0\n    items = list(xs)\n    index = 0\n    while index < len(items):\n        x = items[index]\n        index += 1\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def g(n):\n    out = []\n    stop = n\n    index = 0\n    while index < stop:\n        i = index\n        index += 1\n        out.append(i * 4)\n    return out'),
            ('logic', 'error', 'NoForLoopError > nothing to rewrite', None),
            ('text', 'error', 'NoForLoopError > nothing to rewrite', None),
            ('nested', 'ok', None, 'def n(m):\n    out = 0\n    items1 = list(m)\n    index1 = 0\n    while index1 < len(items1):\n        row = items1[index1]\n        index1 += 1\n        items = list(row)\n        index = 0\n        while index < len(items):\n            v = items[index]\n            index += 1\n            out += v * 7\n    return out'),
            ('zip', 'error', 'NoForLoopError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoForLoopError > nothing to rewrite', None),
        ],
    ),
    'x06_demorgan': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'error', 'NoBooleanOperationError > nothing to rewrite', None),
            ('range', 'error', 'NoBooleanOperationError > nothing to rewrite', None),
            ('logic', 'ok', None, 'def h(a, b):\n    if not ((not a or b) and (not a > 10)):\n        return True\n    return False'),
            ('text', 'error', 'NoBooleanOperationError > nothing to rewrite', None),
            ('nested', 'error', 'NoBooleanOperationError > nothing to rewrite', None),
            ('zip', 'error', 'NoBooleanOperationError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoBooleanOperationError > nothing to rewrite', None),
        ],
    ),
    'x07_boolean_literal': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'error', 'NoBooleanLiteralError > nothing to rewrite', None),
            ('range', 'error', 'NoBooleanLiteralError > nothing to rewrite', None),
            ('logic', 'ok', None, 'def h(a, b):\n    if a and (not b) or a > 10:\n        return not False\n    return not True'),
            ('text', 'error', 'NoBooleanLiteralError > nothing to rewrite', None),
            ('nested', 'error', 'NoBooleanLiteralError > nothing to rewrite', None),
            ('zip', 'error', 'NoBooleanLiteralError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoBooleanLiteralError > nothing to rewrite', None),
        ],
    ),
    'x08_commutative_reorder': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def f(xs):\n    total = 0\n    for x in xs:\n        if x % 2 == 0:\n            continue\n        total = x + total\n    return total'),
            ('range', 'ok', None, 'def g(n):\n    out = []\n    for i in range(n):\n        out.append(4 * i)\n    return out'),
            ('logic', 'error', 'NoCommutativeOperationError > nothing to rewrite', None),
            ('text', 'error', 'NoCommutativeOperationError > nothing to rewrite', None),
            ('nested', 'ok', None, 'def n(m):\n    out = 0\n    for row in m:\n        for v in row:\n            out += 7 * v\n    return out'),
            ('zip', 'error', 'NoCommutativeOperationError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoCommutativeOperationError > nothing to rewrite', None),
        ],
    ),
    'x09_constant_unfold': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def f(xs):\n    total = 0\n    for x in xs:\n        if x % (2 * 1) == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def g(n):\n    out = []\n    for i in range(n):\n        out.append(i * (2 * 2))\n    return out'),
            ('logic', 'ok', None, 'def h(a, b):\n    if a and (not b) or a > 2 * 5:\n        return True\n    return False'),
            ('text', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
            ('nested', 'ok', None, 'def n(m):\n    out = 0\n    for row in m:\n        for v in row:\n            out += v * (7 * 1)\n    return out'),
            ('zip', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
        ],
    ),
    'x10_constant_unfold_add': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def f(xs):\n    total = 0 + 0\n    for x in xs:\n        if x % (1 + 1) == 0 + 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def g(n):\n    out = []\n    for i in range(n):\n        out.append(i * (2 + 2))\n    return out'),
            ('logic', 'ok', None, 'def h(a, b):\n    if a and (not b) or a > 5 + 5:\n        return True\n    return False'),
            ('text', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
            ('nested', 'ok', None, 'def n(m):\n    out = 0 + 0\n    for row in m:\n        for v in row:\n            out += v * (3 + 4)\n    return out'),
            ('zip', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'ok', None, 'def r(x):\n    return (0 + 1) / x'),
        ],
    ),
    'x11_constant_unfold_mult': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, code VARCHAR',
        [
            ('loop', 'ok', None, 'def f(xs):\n    total = 0\n    for x in xs:\n        if x % (2 * 1) == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'ok', None, 'def g(n):\n    out = []\n    for i in range(n):\n        out.append(i * (2 * 2))\n    return out'),
            ('logic', 'ok', None, 'def h(a, b):\n    if a and (not b) or a > 2 * 5:\n        return True\n    return False'),
            ('text', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
            ('nested', 'ok', None, 'def n(m):\n    out = 0\n    for row in m:\n        for v in row:\n            out += v * (7 * 1)\n    return out'),
            ('zip', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
            ('broken', 'error', 'MutationFailedError > SyntaxError', None),
            ('raises', 'error', 'NoConstantUnfoldError > nothing to rewrite', None),
        ],
    ),
    'x12_variable_types': (
        'task_id VARCHAR, name VARCHAR, type VARCHAR',
        [
            ('loop', 'total', 'int'),
            ('range', 'out', 'list'),
            ('range', 'i', 'int'),
            ('nested', 'out', 'int'),
        ],
    ),
    'x13_applicable': (
        'task_id VARCHAR, for_loop BOOLEAN, bool_op BOOLEAN, bool_literal BOOLEAN, commutative BOOLEAN, int_above_one BOOLEAN',
        [
            ('loop', True, False, False, True, True),
            ('range', True, False, False, True, True),
            ('logic', False, True, True, False, True),
            ('text', False, False, False, False, False),
            ('nested', True, False, False, True, True),
            ('zip', False, False, False, False, False),
            ('broken', None, None, None, None, None),
            ('raises', False, False, False, False, False),
        ],
    ),
    'x14_canonical': (
        'task_id VARCHAR, code VARCHAR',
        [
            ('loop', 'def f(xs):\n    total = 0\n    for x in xs:\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'def g(n):\n    out = []\n    for i in range(n):\n        out.append(i * 4)\n    return out'),
            ('logic', 'def h(a, b):\n    if a and (not b) or a > 10:\n        return True\n    return False'),
            ('text', 'def t(s):\n    return s + "it\'s"'),
            ('nested', 'def n(m):\n    out = 0\n    for row in m:\n        for v in row:\n            out += v * 7\n    return out'),
            ('zip', 'def z(a, b):\n    return [x for x, y in zip(a, b)]'),
            ('broken', None),
            ('raises', 'def r(x):\n    return 1 / x'),
        ],
    ),
    'x15_names': (
        'task_id VARCHAR, functions VARCHAR, params VARCHAR',
        [
            ('loop', 'f', 'xs'),
            ('range', 'g', 'n'),
            ('logic', 'h', 'a,b'),
            ('text', 't', 's'),
            ('nested', 'n', 'm'),
            ('zip', 'z', 'a,b'),
            ('broken', None, None),
            ('raises', 'r', 'x'),
        ],
    ),
    'x17_assert_cases': (
        'task_id VARCHAR, rejected INTEGER, args VARCHAR, types VARCHAR, output VARCHAR, output_type VARCHAR',
        [
            ('a', 2, '(1, [2])', 'int,list', "{'x': (1,)}", 'dict'),
            ('a', 2, "('y',)", 'str', 'True', 'bool'),
            ('a', 2, '(-3,)', 'int', 'False', 'bool'),
        ],
    ),
    'x20_rewritten_and_run': (
        'task_id VARCHAR, equal BOOLEAN, error VARCHAR',
        [
            ('loop', True, None),
            ('range', True, None),
            ('logic', True, None),
            ('nested', True, None),
        ],
    ),
    'x24_execute': (
        'task_id VARCHAR, status VARCHAR, error VARCHAR, data VARCHAR, metadata VARCHAR, right BOOLEAN',
        [
            ('loop', 'ok', None, '4', 'int', False),
            ('range', 'ok', None, '[0, 4, 8, 12]', 'list', True),
            ('logic', 'ok', None, 'True', 'bool', True),
            ('text', 'ok', None, '"xit\'s"', 'str', True),
            ('nested', 'ok', None, '42', 'int', True),
            ('zip', 'ok', None, '[1]', 'list', True),
            ('broken', 'error', 'ExecutionError', None, None, None),
            ('raises', 'error', 'ExecutionError', None, None, None),
        ],
    ),
    'x27_test_vectors': (
        'task_id VARCHAR, test VARCHAR, passed BOOLEAN',
        [
            ('loop', 't1', True),
            ('loop', 't2', False),
            ('loop', 't3', False),
            ('loop', 'u.Case.test_even', False),
            ('loop', 'u.Case.test_odd', True),
        ],
    ),
    'x30_suite_gate': (
        'task_id VARCHAR, usable BOOLEAN',
        [
            ('right', True),
            ('other inputs', True),
            ('test', True),
            ('raises', True),
            ('name', True),
            ('undefined', True),
            ('stops', True),
        ],
    ),
    'x34_fuzz': (
        'task_id VARCHAR, tried INTEGER, counterexample VARCHAR',
        [
            ('right', 100, None),
            ('other inputs', 100, '(56,)'),
            ('test', 100, '(0,)'),
            ('raises', 100, None),
            ('undefined', 100, '(0,)'),
        ],
    ),
    'x35_generated_kinds': (
        'kinds VARCHAR, i INTEGER, input VARCHAR',
        [
            ('int', 0, '0'),
            ('int', 1, '1'),
            ('int', 2, '-1'),
            ('int', 3, '56'),
            ('bool', 0, 'False'),
            ('bool', 1, 'False'),
            ('bool', 2, 'True'),
            ('bool', 3, 'True'),
            ('str', 0, "''"),
            ('str', 1, "'b'"),
            ('str', 2, "'ceBd0cE '"),
            ('str', 3, "'1E1d91'"),
            ('list', 0, '[]'),
            ('list', 1, '[35]'),
            ('list', 2, '[-41, -38]'),
            ('list', 3, '[-7, -2, 13, -44, -21]'),
            ('matrix', 0, '[[]]'),
            ('matrix', 1, '[[-9]]'),
            ('matrix', 2, '[[6, -9, -4, -6, 3], [1, 8, -5, 2, 6], [-2, 7, -8, 6, 2], [-2, -9, -8, -2, -9]]'),
            ('matrix', 3, '[[-1, -2, 5, 0, 4], [-1, -9, 0, -4, 0], [7, -2, 7, 4, -9], [-3, 9, -9, -9, 5]]'),
            ('list,int,int', 0, '([], 0, 0)'),
            ('list,int,int', 1, '([35], 1, 1)'),
            ('list,int,int', 2, '([-41, -38], -1, -1)'),
            ('list,int,int', 3, '([-7, -2, 13, -44, -21], 61, 93)'),
        ],
    ),
    'x37_undefined_names': (
        'task_id VARCHAR, names VARCHAR',
        [
            ('right', ''),
            ('other inputs', ''),
            ('test', ''),
            ('raises', ''),
            ('name', ''),
            ('undefined', 'two'),
            ('stops', ''),
        ],
    ),
    'x38_cascade': (
        'task_id VARCHAR, reason VARCHAR',
        [
            ('name', 'wrong name'),
            ('undefined', 'undefined name'),
            ('test', 'test failed'),
            ('stops', 'does not run'),
            ('right', None),
            ('other inputs', 'differs from the reference'),
            ('raises', None),
        ],
    ),
    'x38_static_gates': (
        'task_id VARCHAR, reason VARCHAR',
        [
            ('loop', None),
            ('range', 'wrong name'),
            ('logic', 'wrong name'),
            ('text', 'wrong name'),
            ('nested', 'wrong name'),
            ('zip', 'wrong name'),
            ('broken', 'syntax error'),
            ('raises', 'wrong name'),
        ],
    ),
    'x39_complexity': (
        'task_id VARCHAR, h1 INTEGER, h2 INTEGER, n1 INTEGER, n2 INTEGER, vocabulary INTEGER, length INTEGER, calculated_length DOUBLE, volume DOUBLE, difficulty DOUBLE, effort DOUBLE, time DOUBLE, bugs DOUBLE, cyclomatic INTEGER, maintainability DOUBLE, lines INTEGER, code_lines INTEGER, blank INTEGER',
        [
            ('loop', 3, 5, 3, 6, 8, 9, 16.36452797660028, 27.0, 1.8, 48.6, 2.7, 0.009, 3, 71.1391250772406, 7, 7, 0),
            ('range', 1, 2, 1, 2, 3, 3, 2.0, 4.754887502163468, 0.5, 2.377443751081734, 0.13208020839342968, 0.001584962500721156, 2, 79.7423427057672, 5, 5, 0),
            ('logic', 4, 6, 4, 7, 10, 11, 23.509775004326936, 36.541209043760986, 2.3333333333333335, 85.26282110210897, 4.736823394561609, 0.012180403014586996, 4, 75.38604680058025, 4, 4, 0),
            ('text', 1, 2, 1, 2, 3, 3, 2.0, 4.754887502163468, 0.5, 2.377443751081734, 0.13208020839342968, 0.001584962500721156, 1, 88.5574946685516, 2, 2, 0),
            ('nested', 2, 4, 2, 4, 6, 6, 10.0, 15.509775004326936, 1.0, 15.509775004326936, 0.861654166907052, 0.005169925001442312, 3, 74.28529248621352, 6, 6, 0),
            ('zip', 0, 0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2, 93.16433665200519, 2, 2, 0),
            ('broken', None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
            ('raises', 1, 2, 1, 2, 3, 3, 2.0, 4.754887502163468, 0.5, 2.377443751081734, 0.13208020839342968, 0.001584962500721156, 1, 88.5574946685516, 2, 2, 0),
        ],
    ),
    't08_doctests': (
        'task_id VARCHAR, call VARCHAR, want VARCHAR',
        [
            ('a', 'f(1)', '2'),
            ('a', 'f(2)', '3'),
        ],
    ),
    't09_split_docstring': (
        'task_id VARCHAR, code VARCHAR, docstring VARCHAR',
        [
            ('a', 'def f(x):\n    return x + 1', 'Adds one.'),
        ],
    ),
    't10_without_metadata': (
        'task_id VARCHAR, code VARCHAR',
        [
            ('a', 'def check(c):\n    assert c(1)'),
        ],
    ),
    't11_functions_only': (
        'task_id VARCHAR, code VARCHAR',
        [
            ('loop', 'from os import path\ndef f(xs):\n    total = 0\n    for x in xs:\n        if x % 2 == 0:\n            continue\n        total = total + x\n    return total'),
            ('range', 'from os import path\ndef g(n):\n    out = []\n    for i in range(n):\n        out.append(i * 4)\n    return out'),
            ('logic', 'from os import path\ndef h(a, b):\n    if a and (not b) or a > 10:\n        return True\n    return False'),
            ('text', 'from os import path\ndef t(s):\n    return s + "it\'s"'),
            ('nested', 'from os import path\ndef n(m):\n    out = 0\n    for row in m:\n        for v in row:\n            out += v * 7\n    return out'),
            ('zip', 'from os import path\ndef z(a, b):\n    return [x for x, y in zip(a, b)]'),
            ('broken', 'from os import path\nprint(1)\ndef b(:\n    pass'),
            ('raises', 'from os import path\ndef r(x):\n    return 1 / x'),
        ],
    ),
    'x18_literal_values': (
        'text VARCHAR, data VARCHAR, metadata VARCHAR',
        [
            ('1 + 2 * 3', '7', 'int'),
            ('[1, (2, -3)]', '[1, (2, -3)]', 'list'),
            ('set([1])', '{1}', 'set'),
            ("open('x')", None, None),
            ('2 ** 10', '1024', 'int'),
        ],
    ),
    'x36_equalities': (
        'a VARCHAR, b VARCHAR, same BOOLEAN',
        [
            ('[1, 2]', '[2, 1]', True),
            ('(1, 2)', '(2, 1)', False),
            ('[[1, 2], [3, 4]]', '[[3, 4], [1, 2]]', True),
            ('1', 'True', False),
            ('{1: 2}', '{1: 2}', True),
        ],
    ),
}

#: The nodes of each program's tree, from the root down, with their depths.
TREES: dict[str, str] = {
    'loop': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 2 Assign, 3 Name, 4 Store, 3 Constant, 2 For, 3 Name, 4 Store, 3 Name, 4 Load, 3 If, 4 Compare, 5 BinOp, 6 Name, 7 Load, 6 Mod, 6 Constant, 5 Eq, 5 Constant, 4 Continue, 3 Assign, 4 Name, 5 Store, 4 BinOp, 5 Name, 6 Load, 5 Add, 5 Name, 6 Load, 2 Return, 3 Name, 4 Load',
    'range': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 2 Assign, 3 Name, 4 Store, 3 List, 4 Load, 2 For, 3 Name, 4 Store, 3 Call, 4 Name, 5 Load, 4 Name, 5 Load, 3 Expr, 4 Call, 5 Attribute, 6 Name, 7 Load, 6 Load, 5 BinOp, 6 Name, 7 Load, 6 Mult, 6 Constant, 2 Return, 3 Name, 4 Load',
    'logic': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 3 arg, 2 If, 3 BoolOp, 4 Or, 4 BoolOp, 5 And, 5 Name, 6 Load, 5 UnaryOp, 6 Not, 6 Name, 7 Load, 4 Compare, 5 Name, 6 Load, 5 Gt, 5 Constant, 3 Return, 4 Constant, 2 Return, 3 Constant',
    'text': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 2 Return, 3 BinOp, 4 Name, 5 Load, 4 Add, 4 Constant',
    'nested': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 2 Assign, 3 Name, 4 Store, 3 Constant, 2 For, 3 Name, 4 Store, 3 Name, 4 Load, 3 For, 4 Name, 5 Store, 4 Name, 5 Load, 4 AugAssign, 5 Name, 6 Store, 5 Add, 5 BinOp, 6 Name, 7 Load, 6 Mult, 6 Constant, 2 Return, 3 Name, 4 Load',
    'zip': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 3 arg, 2 Return, 3 ListComp, 4 Name, 5 Load, 4 comprehension, 5 Tuple, 6 Name, 7 Store, 6 Name, 7 Store, 6 Store, 5 Call, 6 Name, 7 Load, 6 Name, 7 Load, 6 Name, 7 Load',
    'raises': '0 Module, 1 FunctionDef, 2 arguments, 3 arg, 2 Return, 3 BinOp, 4 Constant, 4 Div, 4 Name, 5 Load',
}
