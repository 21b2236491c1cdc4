import re
from collections import defaultdict
def brute(rows,k=2,percent=80):
    sets={}
    for d,t in rows:
        w=re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A"<=c<="Z" else c for c in (t or "")))
        sets[d]=frozenset(tuple(w[i:i+k]) for i in range(len(w)-k+1)) if len(w)>=k else frozenset([tuple(w)] if w else [])
    inv=defaultdict(list)
    for d,s in sets.items():
        for x in s: inv[x].append(d)
    parent={d:d for d in sets}
    def find(x):
        while parent[x]!=x: parent[x]=parent[parent[x]]; x=parent[x]
        return x
    for d,s in sets.items():
        cnt=defaultdict(int)
        for x in s:
            for e in inv[x]:
                if e>d: cnt[e]+=1
        for e,c in cnt.items():
            if 100*c>=percent*(len(s)+len(sets[e])-c):
                a,b=find(d),find(e)
                if a!=b: parent[max(a,b)]=min(a,b)
    return sorted((d,len(s),find(d),find(d)==d) for d,s in sets.items())
