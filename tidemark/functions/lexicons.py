"""Word lists. Results depend on exactly these words."""

from __future__ import annotations

#: Negation words of the pair heuristics and rules.
NEGATION = """
    not no never neither nobody nothing nowhere nor cannot can't don't doesn't didn't won't wouldn't
    shouldn't isn't aren't wasn't weren't hasn't haven't hadn't
""".split()

#: Stop words of the pair heuristics and rules.
STOP = """
    a about above after again against all am an and any are aren't as at be because been before being below
    between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during
    each few for from further had hadn't has hasn't have haven't having he he'd he'll he's her here here's
    hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's
    me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over
    own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs
    them themselves then there there's these they they'd they'll they're they've this those through to too
    under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where
    where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've
    your yours yourself yourselves
""".split()

#: Negation words of the claim signals.
CLAIM_NEGATION = """
    not no never neither nor cannot can't isn't aren't wasn't weren't won't wouldn't shouldn't couldn't
    doesn't don't didn't hasn't haven't hadn't without none nobody
""".split()

#: Stop words of the claim signals.
CLAIM_STOP = """
    the a an is are was were be been being have has had do does did will would could should may might shall
    can to of in for on with at by from as into through during before after above below between and but or
    if then than that this these those it its
""".split()

#: Negation words of the heuristic entailment score.
NLI_NEGATION = """
    not no never neither nobody nothing nowhere nor cannot can't isn't aren't wasn't weren't won't wouldn't
    shouldn't couldn't doesn't don't didn't hasn't haven't hadn't without false
""".split()
