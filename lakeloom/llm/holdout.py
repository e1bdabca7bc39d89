"""Hand-checked examples (kind, text) that calibrate the prose classifier; none is used in training."""

_ITEMS = ["pump station north", "spare valve", "second gasket", "ladder, short", "oil filter", "rubber seal", "torque wrench", "copper pipe"]
_ROWS = [("mon", "12", "3.5", "ok"), ("tue", "15", "2.75", "late"), ("wed", "9", "11", "ok"), ("thu", "40", "0.25", "n/a"), ("fri", "31", "7", "ok")]


def _grid(sep: str, head: str = "") -> str:
    return head + "\n".join(sep.join(r) for r in [("day", "count", "hours", "state"), *_ROWS])


EXAMPLES = [
    ("prose", "The crew reached the station at noon and found the valve closed. Nobody had touched it since the storm, so they opened it by hand and waited for the pressure to fall."),
    ("prose", "Why did the second pump stop? It had run without oil for a week, and the alarm was off. We replaced the filter, and it has been quiet since then."),
    ("prose", "Notes on the harbour\n\nThe old crane is slower than the new one, but it can lift more. When the tide is low we use both of them, and the work is done before dark."),
    ("prose", "We met on Tuesday and agreed that the plan\nis too long for one team. The first part will\nbe moved to the spring, when there is more\nlight and the road is dry. The rest can wait."),
    ("prose", "Der Wagen war zu schwer für die Brücke, und deshalb wurde die Ladung auf zwei Fahrten verteilt. Am Abend waren alle Kisten im Lager, und es fehlte nichts."),
    ("prose", "Les ouvriers ont fini le toit avant la pluie. La porte est encore ouverte, mais la clé est dans la boîte, et nous pouvons la fermer ce soir."),
    ("prose", "El barco llegó tarde y no había nadie en el muelle. Los marineros esperaron hasta la noche para descargar las cajas, que estaban mojadas por la lluvia."),
    ("prose", "Most była zamknięty przez trzy dni, ale nikt nie wiedział dlaczego. Po naprawie ruch wrócił, i nie było już żadnych skarg od mieszkańców."),
    ("prose", "橋は三日間閉まっていましたが、理由は誰も知りませんでした。修理のあとで車が戻り、苦情もなくなりました。"),
    ("prose", "The order of the checks matters. First the seal is read, then the weight:\n\n    weigh --all crates\n\nIf the seal is broken, the crate is put aside and the clerk is told about it."),
    ("prose", "Three things were left open at the end of the day. The list is short:\n- the key to the shed\n- the new rope\nAll of the rest was done, and the owner has been told that the bill will come in May."),
    ("prose", "it was a quiet week. the boat stayed in the harbour and the crew slept. on friday the wind turned, and they left before the sun was up."),
    ("list", "\n".join(f"- {x}" for x in _ITEMS)),
    ("list", "Things to bring:\n" + "\n".join(f"* {x}" for x in _ITEMS)),
    ("list", "\n".join(f"{n}. {x}" for n, x in enumerate(_ITEMS, 1))),
    ("list", "To do\n" + "\n".join(f"[ ] {x};" for x in _ITEMS)),
    ("list", "Parts\n" + "\n".join(_ITEMS)),
    ("list", "\n".join(f"{x}." for x in _ITEMS)),
    ("list", "We looked through the shed and found that these are still missing.\n" + "\n".join(f"• {x}" for x in _ITEMS)),
    ("list", "\n".join(f"old {x} of the harbour, in spring" for x in _ITEMS)),
    ("list", "\n".join(f"{c}) {x}: bolts, nuts" for c, x in zip("abcdefgh", _ITEMS, strict=True))),
    ("table", _grid(",")), ("table", _grid(";")), ("table", _grid("\t")), ("table", _grid(" | ")), ("table", _grid("      ")),
    ("table", _grid(",", "The hours of the second week are counted from noon.\n")),
    ("table", "day | count | state\n---|---|---\n" + "\n".join(f"| {a} | {b} | {d} |" for a, b, _, d in _ROWS)),
    ("table", "name;open;sealed;kept\n" + "\n".join(f"{x};yes;no;-" for x in _ITEMS)),
    ("junk", "#$% {}[] 3;;9 ~~ ^&* (0) <> 77 :: !! @@ %% ]] 8-- ++ == 4\\ // ?? ^^ 1;; {{ }} 9~ ## 2"),
    ("junk", "subscribe now subscribe now subscribe now subscribe now subscribe now subscribe now subscribe now subscribe now"),
    ("junk", "Home | About | Contact | Login | Home | Search | Login | About | Sitemap | Contact | Home | Search | Login"),
    ("junk", "xkq vvrt# plm; wqz bnnk trr; ghh zzk qpl# mnv wrt; kkj dfg xzt# vbn qqw; rtp lkj hgf# dsz xcv; bnm qwr"),
    ("junk", "Q2hk8fJz0LmPq7XwVtY5nRb3DcEs9GuHa1KiOo4TyUe6WvZx+MjNl/BpFgCdSr2h\nA8sKd02LmXqPz7WvTt5YnRb3DcEs9GuHa1KiOo4TyUe6WvZx+MjNl/BpFgCdSr2hQ"),
    ("junk", "Ã©Â rÃ¼n â€œnâ€™Ã¤ ï¿½rÃ© Â Ã¼â€œ rÃ¤ï¿½ nÃ©Â râ€™ Ã¼nÃ¤ ï¿½ï¿½ rÂ nâ€œ"),
    ("junk", "=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-\n=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-\n=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-=-"),
    ("junk", "fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail fail"),
    ("junk", "_ _ _ _ _ _ _ _ _ _ _ _ _ _ _ _ _ _ \n_ _ _ _ _ _ _ _ _ _ _ _ _ _ _ _ _ _ "),
]
