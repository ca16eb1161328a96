"""Where rows come from: files of API answers, events, archives, lists."""
